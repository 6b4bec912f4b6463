"""Connected components of an undirected edge table, by alternating large-star
and small-star steps.  Every step is a partial aggregation (which combines a
hot node before the shuffle) and an inner join (which adaptive execution can
split); rounds are cut into the shared folder.  Only a row count and a checksum
come to the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm._cut import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node that has an edge to another node, with the
    smallest node it reaches.  Nulls and loops are ignored."""
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    )
    e = cut(e, "edges")
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        e = cut(small, "stars")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    low = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return low.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def within_block(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest node that each left and right node reaches through the link matrix."""
    a, b = left.copy(), right.copy()
    big = np.iinfo(np.int64).max
    while True:
        before = a.copy(), b.copy()
        for i in range(0, len(a), 512):
            part = linked[i:i + 512]
            a[i:i + 512] = np.minimum(a[i:i + 512], np.where(part, b, big).min(axis=1, initial=big))
            b = np.minimum(b, np.where(part, a[i:i + 512, None], big).min(axis=0, initial=big))
        if (a == before[0]).all() and (b == before[1]).all():
            return a, b
