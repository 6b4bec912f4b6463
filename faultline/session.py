"""Session helpers.

On a cluster the session is created by the platform; the library only reads
its settings.  ``get_session`` is the local/test builder.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(
    master: str = "local[8]", shuffle_partitions: int = 8, app: str = "faultline", driver_memory: str | None = None
) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    It is the one ``spark.checkpoint.dir`` names.  Where that is unset a
    temporary folder serves on a local master only (tests, single-node runs);
    on a cluster such a folder would exist on the driver alone, so it is an
    error there.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the folder
        sc = None
    configured = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc is not None else None)
    if configured is None:
        if sc is None or not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # a core setting can't be changed in a running session; the context keeps the folder
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="faultline-ckpt-"))
        return sc.getCheckpointDir()
    if sc is None:
        return configured
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the session's shared folder and reread, which cuts its lineage:
    a table that several steps read is derived once, and survives lost executors."""
    path = f"{checkpoint_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


PART_CHARS = 1 << 22  # characters of text for each partition of ``spread``


def parts(df: DataFrame, most: int, text: str | None = None) -> int:
    """How many partitions ``df`` takes with ``most`` rows each, or ``most`` characters of ``text``: as
    many as shuffles have, or more, and fewer for a small table."""
    n = (df.agg(F.sum(F.length(text))).first()[0] or 0) if text else df.count()
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-n // most), min(usual, -(-n // max(1, most // 8))))


def spread(df: DataFrame, key: Sequence[str], rows: int | None = None, n: int | None = None, text: str | None = None) -> DataFrame:
    """``df`` dealt out by ``key``, to ``n`` partitions or a number that grows with its rows, or with
    the characters of ``text``.

    The bytes of a table tell little of what is derived from it (text in files and shuffles packs
    to a tenth and less), so neither the files' sizes nor adaptive execution bound a task; a
    number that is given stays.  What follows by ``key`` needs no other shuffle."""
    return df.repartition(n or parts(df, rows or PART_CHARS, text), *key)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``faultline`` importable in the executors' Python workers (Arrow
    UDFs pickle references to it): zip the package once per process and add
    it with ``addPyFile``, the usual way to distribute code to a cluster."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: use spark.addArtifacts on the client instead
        return
    if sc.applicationId in _SHIPPED:
        return
    import shutil

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="faultline-pkg-")
    archive = shutil.make_archive(os.path.join(out_dir, "faultline"), "zip", os.path.dirname(pkg_dir), "faultline")
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
