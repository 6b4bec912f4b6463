"""Corpus encoding: embed each distinct text once and fan vectors back out.

Plan: first text of each sha256 (combined before the shuffle, so a text that
fills a third of all rows costs one row a task) → encoder → left join back on the
hash alone.  The texts themselves travel once, to the de-duplication.  The
encoder is a function of DataFrames that ends in an aggregate or a
``mapInPandas``: a filter on its vectors cannot slip below the de-duplication and
run it on every row.  On the way back the hash of a frequent text is a hot key of
the large side, which adaptive execution splits, as nothing but the vector is
joined to it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.encode import DEFAULT_DIM, hash_vectors

Encoder = Callable[[DataFrame], DataFrame]


def hash_encoder(dim: int = DEFAULT_DIM) -> Encoder:
    """(_h, _t) → (_h, _v) by the hashing encoder."""
    return lambda texts: hash_vectors(texts, ["_h"], "_t", dim, "_v")


def model_encoder(make_predict_fn: Callable[[], Callable], batch_size: int = 128) -> Encoder:
    """UDTF-13 with a learned model: ``make_predict_fn()``, called once a task, returns
    a function from a list of texts to a list of vectors; it gets ``batch_size`` texts at a time."""

    def encode(texts: DataFrame) -> DataFrame:
        schema = T.StructType([texts.schema["_h"], T.StructField("_v", T.ArrayType(T.DoubleType()))])

        def run(batches):
            predict = make_predict_fn()
            for pdf in batches:
                for i in range(0, len(pdf), batch_size):
                    part = pdf.iloc[i:i + batch_size]
                    vectors = [[float(x) for x in v] for v in predict(part["_t"].tolist())]
                    yield pd.DataFrame({"_h": part["_h"].to_numpy(), "_v": vectors})

        return texts.mapInPandas(run, schema)

    return encode


def embed_once(rows: DataFrame, text: str, encoder: Encoder | None = None, out: str = "embedding") -> DataFrame:
    """JON-04: the columns of ``rows`` without ``text``, with ``out`` computed once
    for each distinct text; a null text keeps its row and has no vector."""
    keyed = rows.withColumn("_h", F.sha2(F.col(text), 256))
    distinct = keyed.where(F.col("_h").isNotNull()).groupBy("_h").agg(F.first(text).alias("_t"))
    vecs = (encoder or hash_encoder())(distinct).select("_h", F.col("_v").alias(out))
    kept = [c for c in rows.columns if c not in (text, out)]
    return keyed.select(*kept, "_h").join(vecs, "_h", "left").select(*kept, out)


def text_usage(rows: DataFrame, text: str, id_col: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG-15: one row per distinct text with its use count and first user.

    The per-text usage list of the original is the input itself (rows keyed
    by the hash); it is not collected into one row, since one text may be
    used by a large share of all rows.
    """
    agg = [
        F.count(F.lit(1)).cast("bigint").alias("n_uses"),
        F.min(F.col(id_col)).alias("first_id"),
    ]
    agg += [F.count_distinct(F.col(b)).cast("bigint").alias(f"n_{b}") for b in by]
    return rows.groupBy(F.sha2(F.col(text), 256).alias("text_sha")).agg(*agg)


def usage_rows(rows: DataFrame, text: str, by: Sequence[str]) -> DataFrame:
    """AGG-15 as rows: ``text_sha + by`` for every use of a text; nothing is collected into one row."""
    return rows.select(F.sha2(F.col(text), 256).alias("text_sha"), *by)


def dedup_ratio(rows: DataFrame, text: str) -> DataFrame:
    """AGG-15: texts, distinct texts, and their ratio."""
    per = rows.groupBy(F.sha2(F.col(text), 256).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    n, d = F.sum("_n").cast("bigint"), F.count(F.lit(1)).cast("bigint")
    return per.agg(n.alias("n_texts"), d.alias("n_distinct"), F.round(F.try_divide(d, n), 6).alias("ratio"))


def canonical_by_hash(rows: DataFrame, content: str, id_col: str) -> DataFrame:
    """JON-19: map each row to the first row with identical content (SCA-09 hash)."""
    h = rows.select(id_col, F.sha2(F.col(content), 256).alias("sha"))
    first = h.groupBy("sha").agg(F.min(id_col).alias("canonical_id"))
    return h.join(first, "sha").select(id_col, "sha", "canonical_id")


def sparse(dense: DataFrame, key: Sequence[str], vec: str = "embedding") -> DataFrame:
    """Non-zero entries of a dense vector as ``key + [dim, value]`` rows."""
    x = dense.select(*key, F.posexplode(F.col(vec)).alias("dim", "value"))
    return x.where(F.col("value") != 0).withColumn("dim", F.col("dim").cast("int"))
