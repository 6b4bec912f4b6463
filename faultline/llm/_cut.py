"""Lineage cuts: a table written to the session's shared folder and reread.

The folder is the one ``spark.checkpoint.dir`` names, so every executor sees
the files and a lost executor costs nothing that was cut.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from faultline.session import checkpoint_dir

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """At most ``ROWS`` rows in an Arrow batch of this session: a row is a whole text
    here, and the JVM and the worker hold a batch each."""
    if not 0 < int(spark.conf.get(BATCH, "10000")) <= ROWS:
        spark.conf.set(BATCH, str(ROWS))


def cut(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}/{tag}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
