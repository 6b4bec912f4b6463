"""Reports and result documents: per-bug ranked lists, metrics documents,
ordered project tables with formatted numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import text as T


def ranked_lists(ranked: DataFrame, key: Sequence[str], fields: Sequence[str], rank: str = "rank") -> DataFrame:
    """SNK-04: one row per bug with its results in rank order.  The list is
    bounded by the retrieval depth K."""
    return ranked.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank), *[F.col(f) for f in fields]))),
                    lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("results")
    )


def order_dimension(spark: SparkSession, values: Sequence, name: str, dtype: str) -> DataFrame:
    """SRT-04: a fixed display order as a small dimension ``(name, ord)``."""
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} {dtype}, ord int")


def ordered_rows(metrics: DataFrame, order: DataFrame, on: str) -> DataFrame:
    """JON-16: metrics with the display order; groups outside it come last, all
    with the next number.  The order dimension is a literal list, so its size is
    known when it is built."""
    last = order.select(F.coalesce(F.max("ord") + 1, F.lit(0))).scalar()
    return metrics.join(F.broadcast(order), on, "left").withColumn("ord", F.coalesce("ord", last))


def metrics_document(per_k: DataFrame, per_group: DataFrame, group: str) -> DataFrame:
    """SNK-05: one row a k, ``k, metrics, groups``: the overall numbers as a struct
    and every group's as a list in the groups' order (as many as there are groups)."""
    numbers = [c for c in per_k.columns if c != "k"]
    own = [c for c in per_group.columns if c not in ("k", "is_total")]
    groups = per_group.groupBy("k").agg(F.array_sort(F.collect_list(F.struct(F.col(group), *[F.col(c) for c in own if c != group]))).alias("groups"))
    return per_k.select("k", F.struct(*numbers).alias("metrics")).join(groups, "k", "left")


def merged(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """SET-04: records of both sides by key; where both have a value, the right one's counts."""
    names = [c for c in left.columns if c not in key] + [c for c in right.columns if c not in key and c not in left.columns]
    a = left.select(*key, F.struct(*[c for c in left.columns if c not in key]).alias("_a"))
    b = right.select(*key, F.struct(*[c for c in right.columns if c not in key]).alias("_b"), F.lit(True).alias("_has"))
    j = a.join(b, list(key), "full")
    pick = lambda c: F.when(F.col("_has"), F.col(f"_b.{c}")).otherwise(F.col(f"_a.{c}")) if c in left.columns and c in right.columns else F.col(f"_b.{c}" if c in right.columns else f"_a.{c}")
    return j.select(*key, *[pick(c).alias(c) for c in names])


def format_line(name, passed, total, rate) -> "F.Column":
    """SNK-07/SCA-13: ``name  passed/total  rate%`` with fixed widths."""
    return F.format_string("%-12s %5d/%-5d %7s", name.cast("string"), passed, total, T.fmt_pct(rate))


def latex_row(*cells) -> "F.Column":
    """SNK-07 LaTeX variant: cells joined by `` & `` and ended by ``\\\\``."""
    return F.concat(F.concat_ws(" & ", *[c.cast("string") for c in cells]), F.lit(" \\\\"))


def run_stamp(ts) -> "F.Column":
    """SCA-14/SNK-06: ``MM_dd_yyyy__HH_mm_ss``, the name of a run's folder."""
    return F.date_format(ts, "MM_dd_yyyy__HH_mm_ss")


def write_bucketed(df: DataFrame, table: str, by: Sequence[str], buckets: int, mode: str = "overwrite") -> None:
    """SNK-03: a table bucketed and sorted by its keys, so joins on them need no shuffle."""
    df.write.mode(mode).bucketBy(buckets, *by).sortBy(*by).saveAsTable(table)


def write_vectors(df: DataFrame, path: str, position: str, vec: str = "embedding", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """SNK-02: vectors as arrays of floats, one folder per partition value, in the
    order of ``position`` inside each file, so a range of positions reads few row
    groups.  Rows go to as many tasks as there are; a partition's rows aren't brought
    together."""
    rows = df.withColumn(vec, F.col(vec).cast("array<float>")).sortWithinPartitions(*partition_by, position)
    w = rows.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_json(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """SNK-01..06: results as JSON lines, one folder per partition value."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)
