"""Ranking evaluation: relevance, AP, RR, MAP/MRR, success@k, rates, rollups.

All aggregates are partial/final (map-side combine) and keyed by the query
columns, so the shuffle carries at most one row per query per partition.  The
ranked input is bounded by K rows per query, which keeps the per-query window
(running hits, WIN-02) small even when a single query key is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import text as T

DEFAULT_KS = (1, 5, 10)


def _r6(c: Column) -> Column:
    return F.round(c, 6)


def relevance(
    ranked: DataFrame,
    truth: DataFrame,
    on: Sequence[str],
    item: str,
    truth_item: str | None = None,
    rel_col: str = "rel",
) -> DataFrame:
    """JON-13: flag each ranked row whose ``item`` is in the truth set of its query.

    ``truth`` is de-duplicated on ``on + item`` first so the left join cannot
    multiply ranked rows.
    """
    truth_item = truth_item or item
    t = truth.select(*on, F.col(truth_item).alias("_titem")).distinct().withColumn("_hit", F.lit(1))
    joined = ranked.join(t, [*[ranked[c] == t[c] for c in on], ranked[item] == t["_titem"]], "left")
    return joined.select(
        *[ranked[c] for c in ranked.columns], F.coalesce(t["_hit"], F.lit(0)).cast("int").alias(rel_col)
    )


MATCHES = {"basename": T.basename, "path": lambda c: c}


def path_relevance(ranked: DataFrame, truth: DataFrame, on: Sequence[str], path: str, truth_path: str | None = None, match: str = "basename") -> DataFrame:
    """JON-13 for files (Q5): a ranked file is relevant when its name is that of a true one,
    wherever it stands (``match="basename"``, as published), or when it is the true
    one (``match="path"``)."""
    key = MATCHES[match]
    t = truth.select(*on, key(F.col(truth_path or path)).alias("_key"))
    flagged = relevance(ranked.withColumn("_key", key(F.col(path))), t, on, "_key")
    return flagged.drop("_key")


def average_precision(
    ranked: DataFrame, query: Sequence[str], rank: str = "rank", rel: str = "rel", queries: DataFrame | None = None, relevant: DataFrame | None = None,
) -> DataFrame:
    """AGG-01/02 per query: AP (divided by hits in the list, never 0) and RR.

    Output: ``query + [ap, rr, n_hits, first_hit]``.  With ``queries`` (one row
    each) a query without any candidate is there as well, as a failure.  With
    ``relevant(query, n_relevant)`` AP is divided by the number of all relevant items,
    found or not (Q2).
    """
    w = (
        Window.partitionBy(*query)
        .orderBy(F.col(rank).asc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    hits = ranked.withColumn("_hits", F.sum(F.col(rel)).over(w))
    gained = F.sum(F.when(F.col(rel) == 1, F.col("_hits") / F.col(rank)).otherwise(F.lit(0.0)))
    most = F.sum(F.col(rel))
    if relevant is not None:
        hits = hits.join(relevant.select(*query, F.col("n_relevant").alias("_all")), list(query), "left")
        most = F.coalesce(F.max("_all"), F.lit(0))
    per = hits.groupBy(*query).agg(
        _r6(gained / F.greatest(most, F.lit(1))).alias("ap"),
        _r6(F.coalesce(F.lit(1.0) / F.min(F.when(F.col(rel) == 1, F.col(rank))), F.lit(0.0))).alias("rr"),
        F.sum(F.col(rel)).cast("bigint").alias("n_hits"),
        F.min(F.when(F.col(rel) == 1, F.col(rank))).cast("bigint").alias("first_hit"),
    )
    if queries is None:
        return per
    none = {"ap": F.lit(0.0), "rr": F.lit(0.0), "n_hits": F.lit(0).cast("bigint")}
    return queries.select(*query).join(per, list(query), "left").withColumns({c: F.coalesce(F.col(c), v) for c, v in none.items()})


def map_mrr(per_query: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AGG-03: plain means over queries (optionally per group)."""
    return per_query.groupBy(*by).agg(
        _r6(F.avg("ap")).alias("map"),
        _r6(F.avg("rr")).alias("mrr"),
        F.count(F.lit(1)).cast("bigint").alias("n_queries"),
    )


def success_at_k(
    per_query: DataFrame,
    ks: Sequence[int] = DEFAULT_KS,
    by: Sequence[str] = (),
    first_hit: str = "first_hit",
) -> DataFrame:
    """AGG-04/07: a query passes at k when its first relevant rank is <= k.

    All k are evaluated in one pass: each per-query row is exploded over the
    literal ``ks`` array (no join), then one aggregate.
    MAP/MRR stay at the retrieval depth for every k (Q3).
    """
    x = per_query.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
    passed = F.coalesce(F.col(first_hit) <= F.col("k"), F.lit(False))
    return x.groupBy("k", *by).agg(
        F.count_if(passed).cast("bigint").alias("passed"),
        F.count_if(~passed).cast("bigint").alias("failed"),
        F.count(F.lit(1)).cast("bigint").alias("total"),
        _r6(F.try_divide(F.count_if(passed), F.count(F.lit(1)))).alias("success_rate"),
        _r6(F.avg("ap")).alias("map"),
        _r6(F.avg("rr")).alias("mrr"),
    )


def success_rollup(
    per_query: DataFrame, group: str, ks: Sequence[int] = DEFAULT_KS, first_hit: str = "first_hit"
) -> DataFrame:
    """AGG-07/08: per-group and overall pass counts and rates in one rollup.

    ``is_total`` = ``grouping(group)``; the rate is ``try_divide`` so an empty
    group gives null instead of failing (Q23).
    """
    x = per_query.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
    passed = F.coalesce(F.col(first_hit) <= F.col("k"), F.lit(False))
    return x.rollup("k", group).agg(
        F.count_if(passed).cast("bigint").alias("passed"),
        F.count_if(~passed).cast("bigint").alias("failed"),
        F.count(F.lit(1)).cast("bigint").alias("total"),
        _r6(F.try_divide(F.count_if(passed), F.count_if(passed) + F.count_if(~passed))).alias("success_rate"),
        F.grouping(group).cast("int").alias("is_total"),
    ).where(F.col("k").isNotNull())


def all_required_at_k(
    required: DataFrame,
    predicted: DataFrame,
    query: Sequence[str],
    item: str,
    rank: str = "rank",
    ks: Sequence[int] = DEFAULT_KS,
) -> DataFrame:
    """AGG-05: a query passes at k when **every** required item appears in its
    first k predictions; a query with no required item passes (Q6) and reports
    ``n_required = 0`` so callers can exclude it.

    The best rank of each required item is found by a left join of the
    de-duplicated required set to per-item minimum ranks, then one aggregate
    per query gives the rank at which the last required item appears.
    """
    best = predicted.groupBy(*query, item).agg(F.min(rank).alias("_best"))
    req = required.select(*query, item).distinct()
    per_item = req.join(best, [*query, item], "left")
    per_q = per_item.groupBy(*query).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_required"),
        F.count_if(F.col("_best").isNull()).alias("_missing"),
        F.max("_best").alias("_need"),
    )
    # queries that have predictions but nothing required
    empty = (
        predicted.select(*query)
        .distinct()
        .join(req.select(*query).distinct(), list(query), "left_anti")
        .select(*query, F.lit(0).cast("bigint").alias("n_required"), F.lit(0).cast("bigint").alias("_missing"),
                F.lit(0).cast("bigint").alias("_need"))
    )
    allq = per_q.unionByName(empty)
    x = allq.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
    return x.select(
        *query,
        "k",
        "n_required",
        ((F.col("_missing") == 0) & (F.col("_need") <= F.col("k"))).alias("passed"),
    )


def classify_majority(
    items: DataFrame,
    queries: DataFrame,
    query: Sequence[str],
    found: str = "found",
    has_result: str = "has_result",
) -> DataFrame:
    """AGG-06 + JON-14: legacy three-state rule.

    ``items`` holds one row per expected item with a boolean ``found``;
    ``queries`` lists every query with a boolean ``has_result``.  No result →
    ``skipped``; otherwise ``failed`` when missing*2 >= n (so an empty list
    fails), else ``passed``.
    """
    per_q = items.groupBy(*query).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_items"),
        F.count_if(~F.col(found)).cast("bigint").alias("n_missing"),
    )
    j = queries.join(per_q, list(query), "left")
    n = F.coalesce(F.col("n_items"), F.lit(0))
    miss = F.coalesce(F.col("n_missing"), F.lit(0))
    state = (
        F.when(~F.col(has_result), F.lit("skipped"))
        .when(miss * 2 >= n, F.lit("failed"))
        .otherwise(F.lit("passed"))
    )
    reason = F.when(~F.col(has_result), F.lit("no result"))
    return j.select(*query, n.cast("bigint").alias("n_items"), miss.cast("bigint").alias("n_missing"),
                    state.alias("state"), reason.alias("reason"))


def rates_with_skips(classified: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AGG-09/10: counts per state, both rates, and the count-consistency flag."""
    st = F.col("state")
    return classified.groupBy(*by).agg(
        F.count_if(st == "passed").cast("bigint").alias("passed"),
        F.count_if(st == "failed").cast("bigint").alias("failed"),
        F.count_if(st == "skipped").cast("bigint").alias("skipped"),
        F.count(F.lit(1)).cast("bigint").alias("total"),
        _r6(F.try_divide(F.count_if(st == "passed"), F.count_if(st.isin("passed", "failed")))).alias(
            "rate_without_skips"
        ),
        _r6(F.try_divide(F.count_if(st == "passed"), F.count(F.lit(1)))).alias("rate_with_skips"),
        (F.count_if(st.isin("passed", "failed", "skipped")) == F.count(F.lit(1))).alias("consistent"),
    )


def assert_consistent(rates: DataFrame) -> DataFrame:
    """AGG-10 as a runtime check: fails the job when a row is inconsistent."""
    return rates.withColumn("_chk", F.assert_true(F.col("consistent"))).drop("_chk")
