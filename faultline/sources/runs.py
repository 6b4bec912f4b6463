"""Runs of a job under their stamps: publishing, and reading the latest complete one
(SNK-06, JON-17/18).

A run's rows go to ``root/data/run=<stamp>``, and only when all of them are there its
marker goes to ``root/complete/run=<stamp>``.  Readers look for markers, so a run that
broke off is never taken for the previous one; stamps are compared as the times that
they stand for, and one run's rows are one partition of the folder.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAMP = "MM_dd_yyyy__HH_mm_ss"  # fixed format of a run's name
MARKER = "rows long"


def write_rows(df: DataFrame, root: str, stamp: str) -> None:
    """The first half of :func:`publish`: rows without a marker."""
    df.write.mode("errorifexists").parquet(f"{root}/data/run={stamp}")


def publish(df: DataFrame, root: str, stamp: str) -> None:
    """Write a run whole and mark it complete.  A stamp that is taken is an error."""
    write_rows(df, root, stamp)
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{root}/data/run={stamp}").agg(F.count("*").alias("rows"))
    rows.write.mode("errorifexists").parquet(f"{root}/complete/run={stamp}")


def complete(spark: SparkSession, root: str) -> DataFrame | None:
    """(run, rows, at) of the complete runs; None before the first."""
    try:
        # the schema given leaves the folder's name a text
        marked = spark.read.schema(f"{MARKER}, run string").parquet(f"{root}/complete")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return marked.withColumn("at", F.try_to_timestamp("run", F.lit(STAMP))).where("at is not null")


def latest(spark: SparkSession, root: str, schema: str, before: str | None = None) -> DataFrame:
    """The rows of the latest complete run (``before`` a stamp, where one is given), with
    ``run``; none where there is no such run (Q17)."""
    done = complete(spark, root)
    if done is not None and before is not None:
        done = done.where(F.col("at") < F.try_to_timestamp(F.lit(before), F.lit(STAMP)))
    last = done.agg(F.max_by("run", "at").alias("run")).first().run if done is not None else None
    if last is None:
        return spark.createDataFrame([], f"{schema}, run string")
    return spark.read.schema(f"{schema}, run string").parquet(f"{root}/data").where(F.col("run") == last)
