"""Quality classifier: a regularised quadratic discriminant.

Each class has a mean and a covariance of transformed document statistics,
the covariance shrunk towards the diagonal of the pooled one; a score is the
logistic of the difference of the two log densities (Mahalanobis distance and
determinant from Cholesky factors that are computed once) plus the log odds of
the classes.  A short text's statistics are noise, so a text of n words counts
with n / (n + STEADY) of its distance from the mean of the labelled rows.

Counts, sums and sums of products come from one distributed pass over the
labelled rows, so no sample is drawn; the driver receives two small matrices
whatever the corpus.

Defined results: a null text counts as empty and is scored like one; labels
other than 0 and 1, null labels and null ids teach nothing; with one class or
none among the labels there is nothing to tell apart and every score is the
share of label 1 (1 if there are no labels).  Repeated rows are scored each;
repeated labels of a document count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm import _stats, _text

SHRINK = 0.05  # share of the pooled diagonal in each class covariance
FLOOR = 1e-4  # least variance of a statistic
CUT = 0.3
STEADY = 5.0
WIDTH = len(_stats.FEATURES) + 1


def weighted(m: dict[str, np.ndarray]) -> np.ndarray:
    """Rows x WIDTH: the statistics times a text's weight, and 1 less the weight,
    so that (weight * x + (1 - weight) * mean) is linear in a row whatever the mean."""
    w = (m["words"] / (m["words"] + STEADY))[:, None]
    return np.hstack([_stats.features(m) * w, 1 - w])


def statistics(df: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """``df`` with the weighted statistics of every whole text as an array of doubles, and without the text."""
    keep = [f for f in df.schema.fields if f.name not in (text, out)]
    schema = T.StructType([*keep, T.StructField(out, T.ArrayType(T.DoubleType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in _text.chunks(batch, text):
                x = weighted(_stats.measure(data, offs))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * WIDTH, WIDTH, dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).slice(a, b - a) for f in keep), lists], names=schema.names)

    return df.mapInArrow(run, schema)


class Discriminant:
    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        """``moments``: by class the count, the sum and the sum of outer products of ``weighted`` rows."""
        self.total = {k: m[0] for k, m in moments.items()}
        self.parts = []
        if len(moments) < 2:
            return
        n = sum(self.total.values())
        every = sum(m[1] for m in moments.values())
        self.turn = np.hstack([np.eye(WIDTH - 1), (every[:-1] / max(n - every[-1], 1e-9))[:, None]])
        mean = {k: self.turn @ s / c for k, (c, s, _) in moments.items()}
        within = {k: self.turn @ p @ self.turn.T - c * np.outer(mean[k], mean[k]) for k, (c, _, p) in moments.items()}
        pooled = np.diag(np.maximum(np.diag(sum(within.values())) / n, FLOOR))
        for k in (0, 1):
            shrunk = (1 - SHRINK) * within[k] / self.total[k] + SHRINK * pooled
            factor = np.linalg.cholesky(shrunk + FLOOR * np.eye(len(pooled)))
            self.parts.append((mean[k], np.linalg.inv(factor), np.log(self.total[k] / n) - np.log(np.diag(factor)).sum()))

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.parts:
            n = sum(self.total.values())
            return np.full(len(rows), self.total.get(1, 0) / n if n else 1.0)
        x = rows @ self.turn.T
        log = [c - 0.5 * (((x - m) @ inv.T) ** 2).sum(axis=1) for m, inv, c in self.parts]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def fit(stats: DataFrame, label: str = "quality", col: str = "stats") -> Discriminant:
    """Fit to the rows of ``stats`` whose label is 0 or 1."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            y = batch.column(label).to_numpy(zero_copy_only=False)
            x = batch.column(col).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            for k in (0, 1):
                z = np.column_stack([np.ones((y == k).sum()), x[y == k]])
                total[k] = total.get(k, 0) + z.T @ z
        for k, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, k, np.int32)), pa.array(np.arange(m.size, dtype=np.int32)), pa.array(m.ravel())], names=["k", "i", "v"])

    rows = stats.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias(label), col).mapInArrow(moments, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    found = {}
    for k in (0, 1):
        m = np.zeros((WIDTH + 1) ** 2)
        for r in rows:
            if r.k == k:
                m[r.i] = r.v
        m = m.reshape(WIDTH + 1, WIDTH + 1)
        if m[0, 0] > 0:
            found[k] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return Discriminant(found)


def fold(id_col: str | Column, of: int) -> Column:
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % of


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", folds: int = 5) -> Discriminant:
    """Fit to the labelled documents outside fold 0, whole texts."""
    taught = labels.select(F.col(id_col), F.col("quality")).where(fold(id_col, folds) != 0)
    return fit(statistics(docs.select(id_col, text), text).join(taught, id_col), "quality")


def score(df: DataFrame, model: Discriminant, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the model's score (0 to 1, higher is better) of every whole text."""
    keep = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*keep, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in _text.chunks(batch, text):
                value = model.score(weighted(_stats.measure(data, offs)))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).slice(a, b - a) for f in keep), pa.array(value)], names=schema.names)

    return df.mapInArrow(run, schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = learn(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (F.coalesce(fold("doc_id", 5), F.lit(0)) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Only the documents whose score reaches the cut, columns as they were."""
    return score(docs, learn(docs, labels), out="__score").where(F.col("__score") >= CUT).select(*docs.columns)
