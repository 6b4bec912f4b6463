"""Retrieval and evaluation flows bound to the ``embeddings`` table.

A vector row stands for a chunk and its ``label`` for the relevance signal (the
changed file).  The snapshot in which a failure is searched is the ``source`` of
the document with the vector's id, so evaluation compares vectors inside a
source; every vector is a query there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import evaluate as ev
from faultline.operators.knn import knn_join
from faultline.operators.knn_pruned import knn_pruned
from faultline.session import cut
from faultline.sources.tables import read_table

K = 60


def _emb(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings", "vec_id", "embedding", "label")


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents", "doc_id", "source")
    return _emb(spark, sf).join(d, F.col("vec_id") == F.col("doc_id"), "left").drop("doc_id")


def knn_l2_within_key(spark: SparkSession, sf: str) -> DataFrame:
    """JON-01/WIN-01/SCA-10: K nearest by squared L2 inside each label, self excluded."""
    e = _emb(spark, sf)
    return knn_join(e, e, k=K, query_id="vec_id", corpus_id="vec_id", keys=["label"], exclude_self=True)


def knn_l2_global(spark: SparkSession, sf: str) -> DataFrame:
    e = _emb(spark, sf)
    return knn_pruned(e, e, k=K, query_id="vec_id", corpus_id="vec_id", exclude_self=True)


def knn_cosine_top2(spark: SparkSession, sf: str) -> DataFrame:
    """JON-02/SRT-02/SCA-11: global cosine, best two per query."""
    e = _emb(spark, sf)
    return knn_pruned(e, e, k=2, query_id="vec_id", corpus_id="vec_id", metric="cosine", exclude_self=True)


def ranked_with_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Top-K inside the snapshot with JON-13 relevance: a neighbour is relevant
    when its label equals the query's (the truth set)."""
    e = _emb(spark, sf)
    s = cut(_snapshots(spark, sf), "snapshots")  # read by both sides and by their counts
    ranked = knn_join(
        s, s, k=K, query_id="vec_id", corpus_id="vec_id", keys=["source"], exclude_self=True, corpus_payload=["label"]
    ).withColumnRenamed("label", "n_label")
    truth = e.select("vec_id", "label")
    return ev.relevance(ranked, truth, on=["vec_id"], item="n_label", truth_item="label")


def per_query(spark: SparkSession, sf: str) -> DataFrame:
    return ev.average_precision(ranked_with_relevance(spark, sf), ["vec_id"], queries=_emb(spark, sf).select("vec_id"))


def rank_ap_rr(spark: SparkSession, sf: str) -> DataFrame:
    return per_query(spark, sf)


def rank_map_mrr(spark: SparkSession, sf: str) -> DataFrame:
    return ev.map_mrr(per_query(spark, sf))


def success_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return ev.success_at_k(per_query(spark, sf))


def success_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Per query label ("project") and overall, in one rollup."""
    pq = per_query(spark, sf).join(_emb(spark, sf).select("vec_id", "label"), "vec_id")
    return ev.success_rollup(pq, "label")


QUERIES = {
    "knn_l2_within_key": knn_l2_within_key,
    "knn_l2_global": knn_l2_global,
    "knn_cosine_top2": knn_cosine_top2,
    "rank_ap_rr": rank_ap_rr,
    "rank_map_mrr": rank_map_mrr,
    "success_at_k": success_at_k,
    "success_rollup": success_rollup,
}

_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_L2 = "list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
_DOT = "list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2]))"
_NA = "list_sum(list_transform(a.v, lambda x: x * x))"
_NB = "list_sum(list_transform(b.v, lambda x: x * x))"

_RANKED = f"""
WITH e AS (SELECT vec_id, label, source, CAST(embedding AS DOUBLE[]) AS v FROM embeddings LEFT JOIN documents ON vec_id = doc_id),
d AS (SELECT a.vec_id, b.vec_id AS neighbor_id, b.label AS n_label, round({_L2}, 6) AS distance
      FROM e a JOIN e b ON a.source = b.source AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS rank FROM d),
t AS (SELECT r.vec_id, r.rank, CASE WHEN r.n_label = q.label THEN 1 ELSE 0 END AS rel
      FROM r JOIN e q ON q.vec_id = r.vec_id WHERE r.rank <= {K}),
h AS (SELECT *, sum(rel) OVER (PARTITION BY vec_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hits FROM t),
found AS (SELECT vec_id,
         round(sum(CASE WHEN rel = 1 THEN hits / rank ELSE 0.0 END) / greatest(sum(rel), 1), 6) AS ap,
         round(coalesce(1.0 / min(CASE WHEN rel = 1 THEN rank END), 0.0), 6) AS rr,
         CAST(sum(rel) AS BIGINT) AS n_hits,
         CAST(min(CASE WHEN rel = 1 THEN rank END) AS BIGINT) AS first_hit
       FROM h GROUP BY vec_id),
pq AS (SELECT vec_id, coalesce(ap, 0.0) AS ap, coalesce(rr, 0.0) AS rr, coalesce(n_hits, 0) AS n_hits, first_hit FROM embeddings LEFT JOIN found USING (vec_id))
"""

ORACLE = {
    "knn_l2_within_key": f"""
WITH {_E},
d AS (SELECT a.label, a.vec_id, b.vec_id AS neighbor_id, round({_L2}, 6) AS distance
      FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY label, vec_id ORDER BY distance, neighbor_id) AS rank FROM d)
SELECT label, vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, distance FROM r WHERE rank <= {K}""",
    "knn_l2_global": f"""
WITH {_E},
d AS (SELECT a.vec_id, b.vec_id AS neighbor_id, round({_L2}, 6) AS distance
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS rank FROM d)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, distance FROM r WHERE rank <= {K}""",
    "knn_cosine_top2": f"""
WITH {_E},
d AS (SELECT a.vec_id, b.vec_id AS neighbor_id,
             round({_DOT} / (sqrt({_NA}) * sqrt({_NB})), 6) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor_id) AS rank
      FROM d WHERE score IS NOT NULL AND NOT isnan(score))
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, score FROM r WHERE rank <= 2""",
    "rank_ap_rr": _RANKED + "SELECT * FROM pq",
    "rank_map_mrr": _RANKED
    + "SELECT round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr, CAST(count(*) AS BIGINT) AS n_queries FROM pq",
    "success_at_k": _RANKED
    + """, x AS (SELECT pq.*, k FROM pq, (VALUES (1), (5), (10)) ks(k))
SELECT CAST(k AS INTEGER) AS k,
       CAST(count(*) FILTER (WHERE coalesce(first_hit <= k, false)) AS BIGINT) AS passed,
       CAST(count(*) FILTER (WHERE NOT coalesce(first_hit <= k, false)) AS BIGINT) AS failed,
       CAST(count(*) AS BIGINT) AS total,
       round(count(*) FILTER (WHERE coalesce(first_hit <= k, false)) / count(*), 6) AS success_rate,
       round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr
FROM x GROUP BY k""",
    "success_rollup": _RANKED
    + """, x AS (SELECT pq.*, e.label, k FROM pq JOIN e USING (vec_id), (VALUES (1), (5), (10)) ks(k)),
g AS (SELECT k, label,
       CAST(count(*) FILTER (WHERE coalesce(first_hit <= k, false)) AS BIGINT) AS passed,
       CAST(count(*) FILTER (WHERE NOT coalesce(first_hit <= k, false)) AS BIGINT) AS failed,
       CAST(count(*) AS BIGINT) AS total,
       CAST(grouping(label) AS INTEGER) AS is_total
      FROM x GROUP BY ROLLUP (k, label))
SELECT CAST(k AS INTEGER) AS k, label, passed, failed, total,
       round(passed / nullif(passed + failed, 0), 6) AS success_rate, is_total
FROM g WHERE k IS NOT NULL""",
}
