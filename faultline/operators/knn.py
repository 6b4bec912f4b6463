"""Exact top-K nearest-neighbour join (squared L2 or cosine), optionally within a key.

Plan (no index object, no broadcast of a side that grows with the data):

1. Count query and corpus rows per key, on ids only, so counting never runs an
   encoder.
2. Give every key ``ceil(n / block_rows)`` blocks on each side; a row's block is
   ``pmod(xxhash64(id), n_blocks)``.  The counts reach the rows by a join on key
   and a salt taken from the id, so a hot key is spread from the start; without
   keys they are one row, a scalar subquery, and there is no join.
3. Replicate each query row to every corpus block of its key and vice versa
   (``explode(sequence(...))``) and cogroup on ``(key, qblk, cblk)``: every
   group holds at most ~``block_rows`` rows per side.
4. Inside a group a matrix product finds the candidates, numpy computes their exact
   distances in float64 and keeps a local top-K per query (all ties at the K-th value kept) with the payload
   columns asked for, so the shuffle carries ``blocks x K`` rows per query, never
   the full pair set, and the corpus isn't joined again.
5. A final ``row_number`` over ``(key, query)`` keeps K rows; Catalyst plans it
   with a ``WindowGroupLimit`` before the exchange.

Exact search compares every query with the whole corpus of its key, so its work
is the product of both; give it the key that bounds a search (a snapshot).

Distances are summed dimension by dimension in order (same arithmetic as a
plain SQL sum), rounded to 6 decimals, and ranked by (distance, corpus id).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_BLOCK_ROWS = 8192
SALTS = 16  # ways in which a key's rows are spread to learn its block counts
_CHUNK_ELEMS = 4_000_000  # float64 cells per distance tile (32 MB)


def _distance_tile(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Exact distances for a tile of queries against a block of corpus rows."""
    m, d = q.shape
    n = c.shape[0]
    if metric == "l2":
        acc = np.zeros((m, n), dtype=np.float64)
        for j in range(d):
            diff = q[:, j, None] - c[None, :, j]
            acc += diff * diff
        return acc
    dot = np.zeros((m, n), dtype=np.float64)
    for j in range(d):
        dot += q[:, j, None] * c[None, :, j]
    qn = np.zeros(m, dtype=np.float64)
    cn = np.zeros(n, dtype=np.float64)
    for j in range(d):
        qn += q[:, j] * q[:, j]
        cn += c[:, j] * c[:, j]
    denom = np.sqrt(qn)[:, None] * np.sqrt(cn)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        score = dot / denom
    score[denom == 0] = np.nan
    return score


def _squares(v: np.ndarray) -> np.ndarray:
    out = np.zeros(len(v), dtype=np.float64)
    for j in range(v.shape[1]):
        out += v[:, j] * v[:, j]
    return out


def _pair_scores(q: np.ndarray, c: np.ndarray, at_q: np.ndarray, at_c: np.ndarray, qn: np.ndarray, cn: np.ndarray, metric: str) -> np.ndarray:
    """``_distance_tile`` for pairs of positions, with the same arithmetic."""
    acc = np.zeros(len(at_q), dtype=np.float64)
    for j in range(q.shape[1]):
        if metric == "l2":
            diff = q[at_q, j] - c[at_c, j]
            acc += diff * diff
        else:
            acc += q[at_q, j] * c[at_c, j]
    return acc if metric == "l2" else acc / (np.sqrt(qn)[at_q] * np.sqrt(cn)[at_c])


def _local_topk(qids, qvec, cids, cvec, k, metric, exclude_self, limit=None):
    """Per query, the best K corpus rows of this block (ties at the cut kept), as positions and values.

    A matrix product tells the candidates, up to its rounding error and the sixth digit; they
    alone are compared exactly.  ``limit``: of each query, the value beyond which no row
    matters.  A few rows more than K may come back."""
    out_q, out_c, out_d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    n, d = len(cids), qvec.shape[1]
    qn, cn = _squares(qvec), _squares(cvec)
    sizes = np.concatenate([qn, cn])
    # beyond these sizes the error of the product isn't bounded as below
    plain = bool(np.isfinite(sizes).all() and sizes.max(initial=0) < 1e150 and (metric == "l2" or sizes[sizes > 0].min(initial=1) > 1e-150))
    worst = None if limit is None else (limit if metric == "l2" else -limit)
    tile = max(1, _CHUNK_ELEMS // max(1, n * (1 if plain else max(1, d // 8))))
    tile = min(tile, 4096)
    for s in range(0, len(qids), tile):
        part = slice(s, s + tile)
        if plain:
            key = qvec[part] @ cvec.T
            error = (d + 8) * 2.0**-50
            if metric == "l2":
                key *= -2
                key += qn[part, None]
                key += cn[None, :]
                slack = 1.01e-6 + error * (qn[part] + cn.max(initial=0))
            else:
                with np.errstate(divide="ignore", invalid="ignore"):
                    key /= -(np.sqrt(qn[part])[:, None] * np.sqrt(cn)[None, :])
                slack = np.full(len(key), 1.01e-6 + error)
        else:
            # sort key: ascending distance, or descending similarity
            val = np.round(_distance_tile(qvec[part], cvec, metric), 6)
            key = val if metric == "l2" else -val
            slack = np.zeros(len(key))
        if not plain or metric != "l2":
            key = np.where(np.isnan(key), np.inf, key)
        if exclude_self:
            key[qids[part, None] == cids[None, :]] = np.inf
        near = None if worst is None else key <= (worst[part] + slack)[:, None]
        if near is None or np.count_nonzero(near) > 4 * k * len(key):
            cut = np.partition(key, k - 1, axis=1)[:, k - 1] if n > k else np.full(len(key), np.inf)
            if worst is not None:
                cut = np.minimum(cut, worst[part])
            near = key <= (cut + slack)[:, None]
        rows, cols = np.nonzero(near)
        some = np.isfinite(key[rows, cols])
        rows, cols = rows[some], cols[some]
        out_q.append(s + rows)
        out_c.append(cols)
        out_d.append(np.round(_pair_scores(qvec, cvec, s + rows, cols, qn, cn, metric), 6) if plain else val[rows, cols])
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_d)


def knn_join(
    queries: DataFrame,
    corpus: DataFrame,
    *,
    k: int,
    query_id: str,
    corpus_id: str,
    query_vec: str = "embedding",
    corpus_vec: str = "embedding",
    keys: list[str] | tuple[str, ...] = (),
    metric: str = "l2",
    exclude_self: bool = False,
    corpus_payload: list[str] | tuple[str, ...] = (),
    query_payload: list[str] | tuple[str, ...] = (),
    block_rows: int = DEFAULT_BLOCK_ROWS,
    out_id: str = "neighbor_id",
    out_score: str | None = None,
) -> DataFrame:
    """Exact K nearest corpus rows for every query row, within ``keys``.

    Output: ``keys + [query_id] + query_payload + ["rank", out_id] +
    corpus_payload + [out_score]`` where the score column is ``distance``
    (squared L2, ascending) or ``score`` (cosine, descending).  Fewer than K
    rows are emitted when the key holds fewer candidates (no padding).
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric}")
    keys = list(keys)
    score_col = out_score or ("distance" if metric == "l2" else "score")
    # fresh aliases on both sides: a self-join (queries is corpus) stays unambiguous
    qpay, cpay = [f"_q_{p}" for p in query_payload], [f"_c_{p}" for p in corpus_payload]
    q = queries.select(*[F.col(c).alias(c) for c in keys], F.col(query_id).alias("_qid"), F.col(query_vec).alias("_qv"), *[F.col(p).alias(n) for p, n in zip(query_payload, qpay)])
    c = corpus.select(*[F.col(k).alias(k) for k in keys], F.col(corpus_id).alias("_cid"), F.col(corpus_vec).alias("_cv"), *[F.col(p).alias(n) for p, n in zip(corpus_payload, cpay)])

    def blocks_of(n: Column) -> Column:
        return F.greatest(F.ceil(n / F.lit(block_rows)), F.lit(1)).cast("int")

    # 1-2. block counts (from ids alone), attached without a hot key or a broadcast
    count = F.count(F.lit(1))
    if keys:
        nq = queries.groupBy(*keys).agg(blocks_of(count).alias("_nbq"))
        nc = corpus.groupBy(*keys).agg(blocks_of(count).alias("_nbc"))
        blocks = nq.join(nc, keys).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = lambda df, i: df.withColumn("_salt", F.pmod(F.xxhash64(i), F.lit(SALTS)).cast("int")).join(blocks, [*keys, "_salt"]).drop("_salt")
        q, c = salted(q, "_qid"), salted(c, "_cid")
    else:
        one = lambda df: df.select(blocks_of(count)).scalar()
        q = q.withColumns({"_nbq": one(queries), "_nbc": one(corpus)})
        c = c.withColumns({"_nbq": one(queries), "_nbc": one(corpus)})
    # 3. replicate across the other side's blocks
    qb = q.where(F.col("_qv").isNotNull()).withColumn("_qblk", F.pmod(F.xxhash64("_qid"), F.col("_nbq")).cast("int")).withColumn("_cblk", F.explode(F.sequence(F.lit(0), F.col("_nbc") - 1)))
    cb = c.where(F.col("_cv").isNotNull()).withColumn("_cblk", F.pmod(F.xxhash64("_cid"), F.col("_nbc")).cast("int")).withColumn("_qblk", F.explode(F.sequence(F.lit(0), F.col("_nbq") - 1)))
    grp = [*keys, "_qblk", "_cblk"]
    qb, cb = qb.select(*grp, "_qid", "_qv", *qpay), cb.select(*grp, "_cid", "_cv", *cpay)

    fields = [qb.schema[x] for x in [*keys, "_qid", *qpay]] + [cb.schema[x] for x in ["_cid", *cpay]]
    local_schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields] + [T.StructField("_score", T.DoubleType(), True)])

    def local(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(cpdf) == 0:
            return pd.DataFrame({f.name: pd.Series(dtype="object") for f in local_schema.fields})
        qv = np.stack([np.asarray(v, dtype=np.float64) for v in qpdf["_qv"].to_numpy()])
        cv = np.stack([np.asarray(v, dtype=np.float64) for v in cpdf["_cv"].to_numpy()])
        at_q, at_c, score = _local_topk(qpdf["_qid"].to_numpy(), qv, cpdf["_cid"].to_numpy(), cv, k, metric, exclude_self)
        res = {x: qpdf[x].to_numpy()[at_q] for x in [*keys, "_qid", *qpay]}
        res |= {x: cpdf[x].to_numpy()[at_c] for x in ["_cid", *cpay]}
        return pd.DataFrame(res | {"_score": score})

    partial = qb.groupBy(*grp).cogroup(cb.groupBy(*grp)).applyInPandas(local, local_schema)
    order = F.col("_score").asc() if metric == "l2" else F.col("_score").desc()
    w = Window.partitionBy(*keys, "_qid").orderBy(order, F.col("_cid").asc())
    ranked = partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(
        *keys, F.col("_qid").alias(query_id), *[F.col(n).alias(p) for p, n in zip(query_payload, qpay)],
        "rank", F.col("_cid").alias(out_id), *[F.col(n).alias(p) for p, n in zip(corpus_payload, cpay)], F.col("_score").alias(score_col),
    )
