"""Text → vector encoders and vector helpers.

The hashing encoder is a deterministic stand-in with the encoder contract (text
in, ``array<double>`` of fixed width out): lower-cased word tokens, each hashed
to one of ``dim`` buckets, averaged over the tokens (the masked mean of one-hot
token vectors = the share of each bucket).  :func:`hash_counts` is its sparse
form, a partial aggregation over exploded buckets without any Python worker;
:func:`hash_vectors` makes dense vectors of it.  A learned model plugs in through
:func:`faultline.operators.embed.model_encoder`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the hashing encoder.
TOKEN_SPLIT_RE = r"[^\p{L}\p{N}_]+"
DEFAULT_DIM = 64
# Encoder input limit of the original model (tokens); the hashing encoder
# takes whole texts unless a limit is passed.
MODEL_MAX_TOKENS = 1024


def tokens(text: Column, max_tokens: int | None = None) -> Column:
    t = F.filter(F.split(F.lower(text), TOKEN_SPLIT_RE, -1), lambda x: x != "")
    return truncate(t, max_tokens) if max_tokens else t


def truncate(tok: Column, max_tokens: int) -> Column:
    """PRJ-04: keep the first ``max_tokens`` tokens (model input limit)."""
    return F.slice(tok, 1, int(max_tokens))


def token_bucket(tok: Column, dim: int = DEFAULT_DIM) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 4), 16, 10).cast("int"), F.lit(dim))


def masked_mean(vectors: Column, mask: Column, dim: int) -> Column:
    """AGG-18 on arrays: sum(vec * mask) / max(sum(mask), 1e-9) per dimension."""
    zero = F.array_repeat(F.lit(0.0), dim)
    summed = F.aggregate(
        F.arrays_zip(vectors.alias("v"), mask.alias("m")),
        zero,
        lambda acc, x: F.zip_with(acc, x["v"], lambda a, v: a + v * x["m"].cast("double")),
    )
    denom = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m.cast("double")), F.lit(1e-9))
    return F.transform(summed, lambda s: s / denom)


def hash_counts(df: DataFrame, key: Sequence[str], text: str, dim: int = DEFAULT_DIM, max_tokens: int | None = None) -> DataFrame:
    """UDTF-13 stand-in, sparse: ``key + [dim, value]`` with the share of each
    bucket that occurs.  ``key`` names one text; a text without tokens has no row."""
    key = list(key)
    t = df.select(*key, tokens(F.col(text), max_tokens).alias("_t"))
    x = t.select(*key, F.size("_t").alias("_n"), F.explode("_t").alias("_w"))
    per = x.groupBy(*key, token_bucket(F.col("_w"), dim).alias("dim")).agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    return per.select(*key, F.col("dim").cast("int").alias("dim"), (F.col("_c") / F.col("_n")).alias("value"))


def hash_vectors(df: DataFrame, key: Sequence[str], text: str, dim: int = DEFAULT_DIM, out: str = "embedding") -> DataFrame:
    """UDTF-13 stand-in, dense: ``key + [out]`` for each row of ``df``; a text without tokens, or null, is the zero vector."""
    key = list(key)
    entries = hash_counts(df, key, text, dim).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("_m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    left = df.select(*key).join(entries, key, "left")
    return left.select(*key, F.when(F.col("_m").isNull(), F.array_repeat(F.lit(0.0), dim)).otherwise(full).alias(out))


def hash_encode_sql(text: Column, dim: int = DEFAULT_DIM, max_tokens: int | None = None) -> Column:
    """The vector as one expression, in time tokens x dim: for short texts."""
    b = F.transform(tokens(text, max_tokens), lambda t: token_bucket(t, dim))
    counts = F.aggregate(
        b,
        F.array_repeat(F.lit(0), dim),
        lambda acc, x: F.transform(acc, lambda v, i: F.when(i == x, v + 1).otherwise(v)),
    )
    n = F.greatest(F.size(b).cast("double"), F.lit(1e-9))
    return F.transform(counts, lambda c: c.cast("double") / n)


def l2_squared(a: Column, b: Column) -> Column:
    """SCA-10: squared L2 in double, summed in dimension order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0),
                       lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """SCA-11: dot / (|a| |b|); a zero norm gives null."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                      lambda acc, v: acc + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    return F.when((na == 0) | (nb == 0), F.lit(None).cast("double")).otherwise(dot / (na * nb))
