"""Mixing sources to target weights by soft membership.

A naive Bayes classifier over hashed byte trigrams, fitted to documents of the
labelled table, gives every document posteriors of the domains.  Nonnegative
rates r then minimise the weighted squares of
``sum_i r_i * tokens_i * p_ij - target_j`` by projected gradient steps from
r = 1: a step moves every rate along its posteriors times the residuals and cuts
it at 0.  All rates follow from the posteriors and the residuals of the steps so
far, so a step is one aggregation over the posterior table (written once); the
driver holds one vector of residuals a step and no rates.

The budget is the smallest number of tokens at which no domain has to shrink,
so, up to the softness of memberships, rates are 1 or more.  ``spread`` turns
rates into whole copies by a hash of id and text, at least one each.

Parameters with a bound: the classifier learns from ``TRAIN`` expected documents
of the labelled table, drawn by a hash of their id; domains are those with a
target, so the model has (domains x BUCKETS) numbers.

Defined results: a null or empty text has the domains' shares as posteriors and
no tokens, so its rate is 1 unless residuals move it, and it never weighs; a
document whose domain is null or has no target teaches nothing; without any
labelled document, or without tokens, all rates are 1; repeated rows are
documents of their own with equal rates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm import _text
from faultline.llm._cut import cut

BUCKETS = 1 << 12
TRAIN = 20_000
EVIDENCE = 64.0  # trigrams that a text counts for at most, which keeps memberships soft
STEPS, CLOSE = 60, 1e-4
ROWS = 256  # texts whose counts are held at once


def trigrams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows x BUCKETS counts of hashed byte trigrams, ASCII letters in lower case."""
    n = len(offs) - 1
    if len(data) < 3:
        return np.zeros((n, BUCKETS))
    low = _text.LOWER[data].astype(np.uint64)
    code = _text.mix(low[:-2] << np.uint64(16) | low[1:-1] << np.uint64(8) | low[2:]) % np.uint64(BUCKETS)
    row = np.repeat(np.arange(n), np.diff(offs))
    whole = row[:-2] == row[2:]
    return np.bincount(row[:-2][whole] * BUCKETS + code[whole].astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float64)


class Classifier:
    def __init__(self, domains: list[str], counts: np.ndarray, docs: np.ndarray):
        self.domains = domains
        smooth = counts + 0.5
        self.log = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if len(domains) else np.zeros((0, BUCKETS))
        self.prior = np.log(docs / docs.sum()) if len(domains) else np.zeros(0)

    def posteriors(self, counts: np.ndarray) -> np.ndarray:
        n = counts.sum(axis=1, keepdims=True)
        x = self.prior + counts @ self.log.T * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))
        x = np.exp(x - x.max(axis=1, keepdims=True, initial=-np.inf if x.shape[1] else 0))
        return x / x.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: str = "lang", id_col: str = "doc_id", text: str = "text") -> Classifier:
    """Learn from a bounded, hashed draw of the labelled table's documents; whole texts."""
    ids = labels.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    n = ids.count()
    u = F.pmod(F.xxhash64(F.lit("mixing"), id_col), F.lit(1 << 40)) / float(1 << 40)
    drawn = ids.where(u < min(1.0, TRAIN / max(n, 1)))
    names = sorted(targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), BUCKETS + 1))
        for batch in batches:
            at = np.array([names.index(d) for d in batch.column("domain").to_pylist()])
            for a, b, data, offs in _text.chunks(batch, "text", rows=ROWS):
                x = np.column_stack([trigrams(data, offs), np.ones(b - a)])
                np.add.at(total, at[a:b], x)
        k, i = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(total[k, i])], names=["k", "i", "v"])

    # the draw is bounded, so it is the side to broadcast
    taught = docs.select(id_col, F.col(text).alias("text"), F.col(domain).alias("domain")).where(F.col("domain").isin(names)).join(F.broadcast(drawn), id_col, "left_semi")
    found = taught.select("text", "domain").mapInArrow(run, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((len(names), BUCKETS + 1))
    for r in found:
        total[r.k, r.i] = r.v
    known = total[:, BUCKETS] > 0
    return Classifier([d for d, k in zip(names, known) if k], total[known, :BUCKETS], total[known, BUCKETS])


def members(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``__tokens`` (words) and ``__p`` (posteriors, in the model's order)."""
    keep = [f for f in docs.schema.fields if f.name not in (text, "__tokens", "__p")]
    schema = T.StructType([*keep, T.StructField("__tokens", T.LongType()), T.StructField("__p", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(model.domains)
        for batch in batches:
            for a, b, data, offs in _text.chunks(batch, text, rows=ROWS):
                n = np.bincount(_text.words(data, offs)[2], minlength=b - a)
                p = model.posteriors(trigrams(data, offs))
                lists = pa.ListArray.from_arrays(pa.array((np.arange(b - a + 1) * d).astype(np.int32)), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).slice(a, b - a) for f in keep), pa.array(n.astype(np.int64)), lists], names=schema.names)

    return docs.mapInArrow(run, schema)


def _dot(p: str, values: np.ndarray):
    out = F.lit(0.0)
    for j, v in enumerate(values.tolist()):
        out = out + F.col(p)[j] * F.lit(v)
    return out


def rate(moves: list[np.ndarray]):
    """The rate after the steps whose moves are given: r <- max(0, r - p . move), from 1."""
    if not moves:
        return F.lit(1.0)
    steps = F.array(*(_dot("__p", m) for m in moves))
    return F.aggregate(steps, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - s))


def solve(member: DataFrame, domains: list[str], targets: dict[str, float]) -> list[np.ndarray]:
    """Moves of the projected gradient; each needs one aggregation of ``member``."""
    d = len(domains)
    if not d:
        return []
    t = F.col("__tokens").cast("double")
    pairs = [(j, k) for j in range(d) for k in range(j, d)]
    first = member.agg(F.sum(t).alias("n"), *(F.sum(t * F.col("__p")[j] * F.col("__p")[k]).alias(f"m{j}_{k}") for j, k in pairs), *(F.sum(t * F.col("__p")[j]).alias(f"s{j}") for j in range(d))).first()
    total = first["n"] or 0.0
    if total <= 0:
        return []
    share = np.array([first[f"s{j}"] for j in range(d)]) / total
    weight = np.array([max(targets[x], 0.0) for x in domains])
    weight = weight / weight.sum()
    goal = weight * np.max(np.divide(share, weight, out=np.zeros(d), where=weight > 0))
    moment = np.zeros((d, d))
    for j, k in pairs:
        moment[j, k] = moment[k, j] = first[f"m{j}_{k}"] / total
    scale = 1 / np.maximum(share, 1e-9)  # squares are weighted by it, so small domains count as much as large ones
    root = np.sqrt(scale)
    length = 1 / np.linalg.eigvalsh(moment * root[:, None] * root[None, :]).max()
    moves: list[np.ndarray] = []
    for _ in range(STEPS):
        r = rate(moves)
        now = member.select((t * r).alias("w"), "__p").agg(*(F.sum(F.col("w") * F.col("__p")[j]).alias(f"s{j}") for j in range(d))).first()
        rest = np.array([now[f"s{j}"] for j in range(d)]) / total - goal
        if np.abs(rest).max() <= CLOSE * goal.max():
            break
        moves.append(length * scale * rest)
    return moves


def _copies(rate: str):
    """At least one copy; the fraction of a rate is the chance of one more, by a hash."""
    u = F.pmod(F.col("__u"), F.lit(1 << 40)) / float(1 << 40)
    return F.greatest(F.lit(1), (F.floor(rate) + (u < F.col(rate) - F.floor(rate)).cast("int")).cast("int"))


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: str = "lang", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, domain, posterior, rate, copies) of every row: the likeliest domain and its posterior, the fitted rate, and whole copies."""
    model = fit(docs, labels, targets, domain, id_col, text)
    member = cut(members(docs.select(F.col(id_col), F.col(text), F.xxhash64(F.lit("copies"), F.col(id_col), F.col(text)).alias("__u")), model, text), "members")
    moves = solve(member, model.domains, targets)
    if model.domains:
        top = F.array_max("__p")
        name = F.element_at(F.array(*map(F.lit, model.domains)), F.array_position("__p", top).cast("int"))
    else:
        top, name = F.lit(None).cast("double"), F.lit(None).cast("string")
    out = member.select(id_col, "__u", F.col("__tokens").alias("n_tokens"), name.alias("domain"), top.alias("posterior"), rate(moves).alias("rate"))
    return out.withColumn("copies", _copies("rate")).drop("__u")


def spread(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: str = "lang", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every row as often as its copies say; the order of columns stays."""
    model = fit(docs, labels, targets, domain, id_col, text)
    # rates come from the posteriors, which are computed again beside the text: cheaper than joining texts
    narrow = docs.select(F.col(text), F.lit(0).alias("__k"))
    moves = solve(cut(members(narrow, model, text), "members"), model.domains, targets)
    whole = docs.withColumns({"__text": F.col(text), "__u": F.xxhash64(F.lit("copies"), F.col(id_col), F.col(text))})
    rated = members(whole, model, "__text").withColumn("__rate", rate(moves))
    return rated.withColumn("__copy", F.explode(F.sequence(F.lit(1), _copies("__rate")))).select(*docs.columns)
