"""Rows by their place: numbering in a global order, and joining two tables whose
rows belong together by position alone (JON-03).

A global ``row_number`` would bring all rows to one task.  Here rows are dealt out by
ranges of the order and sorted in their range; each range's number of rows, summed over
the ranges before it, is where its own numbers begin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import cut

POSITION = "position"


def numbered(df: DataFrame, order: Sequence[str | Column], partitions: int | None = None) -> DataFrame:
    """``df`` with ``position``, from 0 in the order given (which must be total for the
    numbers to be the same in each run).

    The sorted rows are written once: the ranges' sizes and their rows are two
    readings of the same table.  Sizes are one row a range."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # a row's range and its place there, as Spark numbers rows: range << 33 | place
    rows = cut(ranges.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = rows.withColumns({"_part": part, "_place": place}).join(F.broadcast(offsets), "_part")
    return placed.select(*df.columns, (F.col("_before") + F.col("_place")).alias(POSITION))


def zipped(left: DataFrame, right: DataFrame, left_order: Sequence[str | Column], right_order: Sequence[str | Column]) -> DataFrame:
    """JON-03: the columns of both sides, row by row in their orders, with ``position``.
    Sides of different length don't belong together: that is an error."""
    a, b = numbered(left, left_order), numbered(right, right_order)
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} rows can't be joined with {m} rows by position")
    return a.join(b, POSITION)
