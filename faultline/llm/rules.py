"""Quality rules: an isolation forest on rule statistics.

Every document gets the counts that the usual rules look at.  A forest of
random splits, grown on documents drawn by a hash of their id (``TREES`` trees
of about ``SAMPLE`` documents each, the method's own sample and the only one),
gives each document a mean path length; short paths mark anomalous documents.
The cut on that anomaly score comes from all labelled rows: among 1000 steps
the one with the least weighted error.

Trees are grown in tasks, one group of about ``SAMPLE`` rows each; the driver
receives the forest (``TREES`` rows of at most ``2 * SAMPLE`` nodes) and two
histograms of 1000 steps, whatever the corpus.

Defined results: a null text counts as empty and fails the base rule; without
labels the cut rejects nothing; without documents there is no tree and every
score is 0.  Repeated rows are judged each and are all kept in the output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import _stats, _text

TREES, SAMPLE = 100, 256
STEPS = 1000
GOOD_WEIGHT = 50  # a share lost of label 1 weighs as much as fifty times that share kept of label 0
COUNTS = ("words", "word_chars", "symbols", "dup_lines", "repeat_words")
# The rates that rules cut on, among them all that the query reports; sizes of texts say nothing of quality, and the README
# gives the figures of the rates left out.
USED = [_stats.FEATURES.index(f) for f in ("word_length", "symbols", "upper", "top_word", "doubled", "repeat_words", "dup_lines")]


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Expected path length of an unsuccessful search among n."""
    n = np.asarray(n, dtype=float)
    m = np.maximum(n, 2)
    return np.where(n < 2, 0.0, np.where(n < 3, 1.0, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m))


def grow(x: np.ndarray, seed: int) -> dict[str, list]:
    """One tree as parallel lists; a leaf has feature -1 and its path length as ``cut``."""
    rng = np.random.default_rng(seed)
    tree: dict[str, list] = {"feature": [], "cut": [], "left": [], "right": []}
    limit = int(np.ceil(np.log2(max(SAMPLE, 2))))
    todo = [(x, 0, -1, "left")]
    while todo:
        rows, depth, parent, side = todo.pop()
        at = len(tree["feature"])
        if parent >= 0:
            tree[side][parent] = at
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
        varied = np.flatnonzero(high > low)
        if depth >= limit or len(rows) < 2 or not len(varied):
            values = (-1, float(depth + mean_path(len(rows))))
        else:
            f = int(rng.choice(varied))
            values = (f, float(rng.uniform(low[f], high[f])))
        for name, v in zip(("feature", "cut", "left", "right"), (*values, -1, -1)):
            tree[name].append(v)
        if values[0] >= 0:
            below = rows[:, values[0]] < values[1]
            todo += [(rows[below], depth + 1, at, "left"), (rows[~below], depth + 1, at, "right")]
    return tree


def anomaly(forest: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    """0 to 1, higher for rows that random splits isolate sooner."""
    if not forest:
        return np.zeros(len(x))
    total = np.zeros(len(x))
    for feature, cut, left, right in forest:
        at = np.zeros(len(x), dtype=np.int64)
        while (inner := np.flatnonzero(feature[at] >= 0)).size:
            node = at[inner]
            at[inner] = np.where(x[inner, feature[node]] < cut[node], left[node], right[node])
        total += cut[at]
    return 2.0 ** (-total / len(forest) / float(mean_path(SAMPLE)))


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> list[tuple[np.ndarray, ...]]:
    n = docs.count()
    if not n:
        return []
    share = min(1.0, SAMPLE / n)
    # a document stands in each tree with that chance, so every tree has about SAMPLE of them
    mine = F.filter(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.pmod(F.xxhash64(F.lit("forest"), t, F.col(id_col)), F.lit(1 << 40)) < share * (1 << 40))
    drawn = docs.select(F.col(text).alias("text"), mine.alias("trees")).where(F.size("trees") > 0)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in _text.chunks(batch, "text"):
                x = _stats.features(_stats.measure(data, offs))[:, USED]
                yield pa.RecordBatch.from_arrays([batch.column("trees").slice(a, b - a), pa.array(list(x), pa.list_(pa.float64()))], names=["trees", "x"])

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack(rows["x"].to_numpy())
        tree = grow(x[np.lexsort(x.T)], int(key[0]))
        return pd.DataFrame({k: [v] for k, v in tree.items()})

    rows = drawn.mapInArrow(measured, "trees array<int>, x array<double>").select(F.explode("trees").alias("tree"), "x")
    grown = rows.groupBy("tree").applyInPandas(one, "feature array<int>, cut array<double>, left array<int>, right array<int>").collect()
    return [tuple(np.array(c) for c in (t["feature"], t["cut"], t["left"], t["right"])) for t in grown]


def measure(docs: DataFrame, forest: list[tuple[np.ndarray, ...]], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, anomaly) of every whole text."""
    names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "anomaly"]
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in _text.chunks(batch, text):
                m = _stats.measure(data, offs)
                value = anomaly(shared.value, _stats.features(m)[:, USED])
                yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(a, b - a), *(pa.array(m[c].astype(np.int64)) for c in COUNTS), pa.array(value)], names=names)

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names[1:6]) + ", anomaly double")


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def calibrate(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> float:
    """The cut with the least weighted error over labelled rows that pass the base rule."""
    known = labels.where(F.col("quality").isin(0, 1)).select(id_col, "quality")
    step = F.floor(F.col("anomaly") * STEPS).cast("int")
    found = measured.where(f"not ({BASE_FAILED})").join(known, id_col).groupBy(step.alias("step"), "quality").count().collect()
    n = np.zeros((2, STEPS + 2))
    for r in found:
        n[r["quality"], r["step"]] += r["count"]
    if not n[1].sum() or not n[0].sum():
        return 2.0
    # rows from step s on are rejected
    lost = np.append(n[1][::-1].cumsum()[::-1], 0) / n[1].sum()
    caught = np.append(n[0][::-1].cumsum()[::-1], 0) / n[0].sum()
    cost = GOOD_WEIGHT * lost - caught
    return float(np.flatnonzero(cost == cost.min())[-1]) / STEPS


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    measured = measure(docs, fit(docs, id_col, text), id_col, text)
    cut = calibrate(measured, labels, id_col)
    return measured.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < cut))
