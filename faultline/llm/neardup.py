"""Near-duplicate embeddings: an exact range join in the metric space of angles.

Vectors link if their labels are equal and their cosine is at least
``THRESHOLD``.  Equal vectors of a label are one node with a multiplicity.
Pivots, nodes drawn by a hash, cut the space into cells; a node's home is the
cell of its nearest pivot.  Whatever links with a node of cell i can reach cell i:
by the triangle inequality a vector reaches
cell i only if its angle to pivot i exceeds neither the cell's radius by more
than the threshold's angle, nor its angle to its own pivot by more than twice
that; the distance to the plane between both pivots bounds it further.  The cells
that a node reaches are the bits of one number.

The nodes of a label, ordered by home cell, are dealt into blocks of about ``BLOCK``.
A node travels once to each pair of its own block and one that holds a cell that it
reaches, so its copies follow the number of blocks, never that of cells.  A pair of blocks
is one group: matrix products of tiles whose cells reach each other, which return, for
each node, its number of links in that pair and one edge towards the smallest node of
its local component, never the pairs.  Vectors travel as they are stored.

Defined results: vectors that are null, empty or zero, or hold null or
non-finite components, and vectors without a label link with nothing; vectors of
different lengths do not link; repeated rows are vectors of their own and link
with each other; null ids take part but never name a component, and a row with a
null id is kept only if nothing with an id links to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm._components import components, within_block
from faultline.llm._cut import cut

THRESHOLD = 0.93
BLOCK = 32768  # nodes of a block, if their vectors have at most DIMENSIONS numbers; fewer of longer ones
DIMENSIONS = 64
TILE = 2048
CELL = 8192  # nodes for each pivot
PIVOTS = (4, 64)  # least and most: a cell is a bit


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (by their largest component first, so squares stay finite)."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length that occurs."""
    offs = vectors.offsets.to_numpy()
    size = np.diff(offs)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    start = offs[:-1] - offs[0]
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield rows, flat[start[rows][:, None] + np.arange(d)]


def _nodes(df: DataFrame, id_col: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """All rows as (id, node), and the nodes (node, label, v, m, least); node is null where nothing can link.
    Vectors of floats stay such."""
    v = F.col("v")
    short = df.schema[vector].dataType.simpleString() == "array<float>"
    read = df.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    read = read.withColumn("node", F.when(F.coalesce(sound & F.col("label").isNotNull(), F.lit(False)), F.xxhash64("label", "v")))
    nodes = read.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first(v.cast("array<float>") if short else v).alias("v"), F.count("*").alias("m"), F.min("id").alias("least"))
    return read.select("id", "node"), nodes


def _pivots(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Unit vectors of the pivots by length: a fixed number, drawn by a hash."""
    n = nodes.count()
    k = int(np.clip(-(-n // CELL), *PIVOTS))
    out: dict[int, list] = {}
    for r in nodes.select("v").orderBy(F.xxhash64(F.lit("pivot"), "node")).limit(k).collect():
        out.setdefault(len(r.v), []).append(r.v)
    return {d: unit(np.array(v)) for d, v in out.items()}


def _angles(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dots = x @ pivots.T
    return dots, np.arccos(np.clip(dots, -1, 1))


def _radii(nodes: DataFrame, pivots: dict[int, np.ndarray]) -> dict[tuple[int, int], float]:
    """The largest angle of a home member, by length and pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in by_length(batch.column("v")):
                if (p := pivots.get(x.shape[1])) is not None:
                    _, angle = _angles(unit(x), p)
                    home = angle.argmin(axis=1)
                    most = np.zeros(len(p))
                    np.maximum.at(most, home, angle[np.arange(len(x)), home])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), x.shape[1])), pa.array(np.arange(len(p))), pa.array(most)], names=["d", "cell", "r"])

    found = nodes.select("v").mapInArrow(run, "d long, cell long, r double").groupBy("d", "cell").agg(F.max("r").alias("r")).collect()
    return {(r.d, r.cell): r.r for r in found}


def _celled(nodes: DataFrame, pivots: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """Nodes with the length of their vectors, their home cell and the cells that they reach (``goes``)."""
    radii = _radii(nodes, pivots)
    theta, chord, slip = float(np.arccos(threshold)), float(np.sqrt(2 - 2 * threshold)), 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in by_length(batch.column("v")):
                x, d = unit(x), x.shape[1]
                n = len(x)
                if (p := pivots.get(d)) is None:
                    own, bits = np.zeros(n, np.int64), np.ones(n, np.int64)
                else:
                    dots, angle = _angles(x, p)
                    own = angle.argmin(axis=1)
                    r = np.array([radii.get((d, i), 0.0) for i in range(len(p))])
                    nearest, top = angle.min(axis=1, keepdims=True), dots[np.arange(n), own][:, None]
                    between = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))[own]
                    goes = (angle <= r + theta + slip) & (angle <= nearest + 2 * theta + slip) & (top - dots <= chord * between + slip)
                    goes[np.arange(n), own] = True
                    bits = np.bitwise_or.reduce(np.where(goes, np.int64(1) << np.arange(len(p)), 0), axis=1)
                kept = [batch.column(c).take(pa.array(rows)) for c in ("label", "node", "m", "v")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(n, d)), pa.array(own), pa.array(bits)], names=["label", "node", "m", "v", "d", "cell", "goes"])

    return nodes.select("label", "node", "m", "v").mapInArrow(run, nodes.select("label", "node", "m", "v", *(F.lit(0).cast("long").alias(c) for c in ("d", "cell", "goes"))).schema)


def _places(celled: DataFrame) -> DataFrame:
    """Of each home cell of a label: where its nodes stand among the label's ``total``, in how many ``blocks``
    these are dealt, and the cells that each block holds (``held``)."""
    key = ["label", "d"]
    count = celled.groupBy(*key, "cell").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    at = count.select(*key, "cell", "n", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy(*key)).alias("total"))
    at = at.withColumn("blocks", F.ceil(F.col("total") * F.greatest(F.lit(1), F.col("d") / DIMENSIONS) / BLOCK).cast("long"))
    reaches = F.sequence(_block(F.col("start")), _block(F.col("start") + F.col("n") - 1))
    held = at.select(*key, F.explode(reaches).alias("block"), F.expr("shiftleft(1L, int(cell))").alias("bit")).groupBy(*key, "block").agg(F.bit_or("bit").alias("bits"))
    held = held.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("block", "bits"))).alias("held"))
    return cut(at.join(held, key), "places")


def _block(position: Column) -> Column:
    return F.floor(position * F.col("blocks") / F.col("total")).cast("long")


def _dealt(celled: DataFrame) -> DataFrame:
    """Nodes, once for each pair (``low``, ``high``) of blocks in which they may link; ``block`` is their own."""
    key = ["label", "d", "cell"]
    at = celled.join(_places(celled), key).withColumn("block", _block(F.col("start") + F.pmod(F.xxhash64("node"), F.col("n"))))
    meets = F.filter("held", lambda x: (x["block"] == F.col("block")) | (x["bits"].bitwiseAND(F.col("goes")) != 0))
    at = at.withColumn("other", F.explode(F.transform(meets, lambda x: x["block"])))
    return at.select("label", "d", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cell", "goes", "node", "m", "v")


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that have an edge, and the smallest that each reaches."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    at, to = at[:len(a)], at[len(a):]
    low = np.arange(len(node))
    while True:
        before = low.copy()
        np.minimum.at(low, at, before[to])
        np.minimum.at(low, to, before[at])
        low = low[low]
        if (low == before).all():
            return node, node[low]


def _compared(celled: DataFrame, threshold: float) -> DataFrame:
    """(node, n, to): a node's links in one pair of blocks and a smaller node of its component, if there is one."""

    def run(table: pa.Table) -> pa.Table:
        block, cell, goes, node, m = (table.column(c).to_numpy() for c in ("block", "cell", "goes", "node", "m"))
        alone = table.column("low")[0] == table.column("high")[0]
        _, x = next(by_length(table.column("v").combine_chunks()))
        x = unit(x)
        order = np.lexsort((node, cell, block))
        tiles = []  # of one block each
        for b in np.unique(block):
            own = order[block[order] == b]
            tiles += [(b, own[i:i + TILE]) for i in range(0, len(own), TILE)]
        reach = [(np.bitwise_or.reduce(goes[t]), np.bitwise_or.reduce(np.int64(1) << cell[t])) for _, t in tiles]
        n, a, b = np.zeros(len(node), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, (p, s) in enumerate(tiles):
            for j in range(i, len(tiles)):
                q, t = tiles[j]
                if (p == q) != alone or not (reach[i][0] & reach[j][1]):
                    continue
                linked = x[s] @ x[t].T >= threshold
                if i == j:
                    np.fill_diagonal(linked, False)
                rows, cols = linked.any(axis=1), linked.any(axis=0)
                if rows.any():
                    linked, s2, t2 = linked[np.ix_(rows, cols)], s[rows], t[cols]
                    u, v = np.nonzero(linked)
                    n[s2] += np.bincount(u, weights=m[t2][v], minlength=len(s2)).astype(np.int64)
                    if i != j:
                        n[t2] += np.bincount(v, weights=m[s2][u], minlength=len(t2)).astype(np.int64)
                    for nodes, low in zip((node[s2], node[t2]), within_block(linked, node[s2], node[t2])):
                        a.append(nodes)
                        b.append(low)
        found, low = _least(np.concatenate(a), np.concatenate(b))
        by_node = np.argsort(node)
        hit = by_node[np.searchsorted(node, found, sorter=by_node)]
        return pa.table({"node": pa.array(found), "n": pa.array(n[hit]), "to": pa.array(low)})

    return _dealt(celled).groupBy("label", "d", "low", "high").applyInArrow(run, "node long, n long, to long")


def join(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    rows, nodes = _nodes(df, id_col, vector, label)
    nodes = cut(nodes, "nodes")
    found = cut(_compared(_celled(nodes, _pivots(nodes), threshold), threshold), "links")
    group = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    own = nodes.select("node", "m", "least").join(links, "node", "left").join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = own.groupBy("component").agg(F.min("least").alias("component_id"))
    known = own.join(least, "component").select("node", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    return rows.join(known, "node", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
