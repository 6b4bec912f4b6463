"""Exact global top-K that skips what can't be near (JON-02, SRT-02).

Corpus vectors are dealt out to the cell of their nearest pivot; a cell is a ball of
known radius.  A query first meets the cells nearest to it until they hold K rows,
which gives a bound of its K-th distance and nothing else.  Queries are then dealt into blocks by their
nearest cell, and the corpus goes once to each block in which a query's bound reaches into the
ball.  A block is one task: its queries stay there with their best K so far, while the
corpus passes by in the order of its ids, in batches; tiles of queries skip the rows of cells that none of
them reaches.  All is compared exactly, so the bounds decide only
what is skipped: results are those of ``knn.knn_join`` without keys.

Pivots are rows of the corpus drawn by hash, a bounded number, and so are the cells and
the tables about them.  What moves is the corpus times the number of blocks of queries, and K rows a query;
a task holds a block of queries, a batch and the ids of the corpus.  Vectors of floats move as such.  Work falls with how well
vectors cluster; without any structure each query meets every row, as it would there.

Cosine is searched as the distance of unit vectors.  Vectors that are null, empty or (for
cosine) of length zero are no one's neighbours.  All vectors have one dimension.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.knn import DEFAULT_BLOCK_ROWS, _local_topk
from faultline.session import cut

MAX_PIVOTS = 1024
SLACK = 1e-6  # scores are rounded to six digits
TILE = 4096
BLOCKS = 8  # of queries, in each of which as many blocks of ``block_rows`` fit
DIMENSIONS = 64  # numbers of a vector, beyond which a block has fewer rows
QUERIES = 512  # of a tile


def _stack(a: pa.Array) -> np.ndarray:
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(size > 0, size, 1)


def _usable(vec: str, metric: str):
    some = F.col(vec).isNotNull() & (F.size(vec) > 0)
    return some & F.exists(vec, lambda x: x != 0) if metric == "cosine" else some


class _Space:
    """Distances to the pivots, in the space where the triangle inequality holds."""

    def __init__(self, pivots: np.ndarray, metric: str):
        self.metric, self.pivots = metric, _unit(pivots) if metric == "cosine" else pivots

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        v = _unit(vectors) if self.metric == "cosine" else vectors
        return np.stack([np.sqrt(((v - p) ** 2).sum(axis=1)) for p in self.pivots], axis=1)

    def reach(self, score: np.ndarray) -> np.ndarray:
        """The distance that a score stands for, not less."""
        square = 2 - 2 * (score - SLACK) if self.metric == "cosine" else score + SLACK
        return np.sqrt(np.maximum(square, 0)) * (1 + 1e-9) + 1e-9


def pivots(corpus: DataFrame, ident: str, vec: str, block_rows: int) -> np.ndarray:
    """Rows of the corpus, one for each block of it, MAX_PIVOTS at most."""
    n = corpus.count()
    k = min(MAX_PIVOTS, max(1, -(-n // block_rows)))
    rows = corpus.select(F.col(vec).cast("array<double>").alias("v"), F.xxhash64(F.col(ident)).alias("h"), F.col(ident).alias("i")).orderBy("h", "i").limit(k).collect()
    return _in_line(np.array([r.v for r in rows], dtype=np.float64))


def _in_line(points: np.ndarray) -> np.ndarray:
    """Points each followed by the nearest of those that are left, so that neighbours in number are near."""
    left, out = np.arange(len(points)), []
    while len(left):
        far = ((points[left] - points[out[-1]]) ** 2).sum(axis=1) if out else np.zeros(len(left))
        nearest = int(np.argmin(np.nan_to_num(far, nan=np.inf)))
        out.append(left[nearest])
        left = np.delete(left, nearest)
    return points[out]


def visits(queries: DataFrame, space: _Space, cells: pd.DataFrame, need: int, first: bool, bundle: int = 1, again: bool = False, kept: tuple[str, ...] = ()) -> DataFrame:
    """``queries`` (with ``_qv`` and ``_kth``; their columns ``kept``, or all) once for each ``bundle`` of cells (``_cell``) in which
    they meet any, with those cells as ``_bits``: in the first round the nearest ones until they hold ``need`` rows, in the second
    those of the others that reach into the K-th score (all, where there is none)."""
    shared = queries.sparkSession.sparkContext.broadcast((space, cells["cell"].to_numpy(), cells["n"].to_numpy(), cells["radius"].to_numpy()))
    schema = queries.select(*(kept or ["*"]), F.lit(0).alias("_cell"), F.lit(0).cast("long").alias("_bits")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, number, rows, radius = shared.value
        bit = np.int64(1) << (number % bundle).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], np.diff(number // bundle) > 0]))
        for whole in batches:
            for a in range(0, whole.num_rows, TILE):
                batch = whole.slice(a, TILE)
                far = space.distances(_stack(batch.column("_qv")))[:, number]
                order = np.argsort(far, axis=1, kind="stable")
                held = np.cumsum(rows[order], axis=1)
                near = np.empty(far.shape, dtype=bool)
                np.put_along_axis(near, order, held - rows[order] < need, axis=1)
                if not first:
                    kth = batch.column("_kth").to_numpy(zero_copy_only=False).astype(np.float64)
                    reach = np.where(np.isnan(kth), np.inf, space.reach(kth))
                    near = (again | ~near) & (far - radius[None, :] <= reach[:, None])
                bits = np.add.reduceat(near * bit[None, :], starts, axis=1)
                row, at = np.nonzero(bits)
                own = [batch.column(f.name).take(pa.array(row)) for f in schema.fields[:-2]]
                yield pa.RecordBatch.from_arrays([*own, pa.array((number[starts] // bundle)[at].astype(np.int32)), pa.array(bits[row, at])], names=schema.names)

    return queries.mapInArrow(run, schema)


class _Block:
    """A block of queries with the best K of what has passed by."""

    def __init__(self, space: _Space, cells: tuple[np.ndarray, np.ndarray], k: int, exclude_self: bool):
        self.space, (self.number, self.radius), self.k, self.exclude_self = space, cells, k, exclude_self
        self.sign = 1 if space.metric == "l2" else -1  # scores times it ascend
        self.queries, self.waiting, self.rows, self.seen, self.ids = [], [], 0, 0, []

    def add(self, batch: pa.RecordBatch) -> None:
        asks = batch.column("_asks")
        own, others = batch.filter(asks), batch.filter(pc.invert(asks))
        if own.num_rows:
            self.queries.append(own)
        if others.num_rows:
            self.waiting.append(others)
            self.rows += others.num_rows
            if self.rows >= TILE * 2:
                self.compare()

    def _ready(self) -> None:
        t = pa.Table.from_batches(self.queries)
        self.queries = []
        t = t.take(np.argsort(t.column("_cell").to_numpy(), kind="stable")).combine_chunks()
        self.qid, self.vectors = t.column("_qid").combine_chunks(), _stack(t.column("_v").combine_chunks())
        kth = t.column("_kth").to_numpy().astype(np.float64)
        self.limit = np.where(np.isnan(kth), np.inf, self.sign * kth)
        self.best, self.at = np.full((len(kth), self.k), np.inf), np.full((len(kth), self.k), -1, np.int64)
        self.tiles = [slice(i, i + QUERIES) for i in range(0, len(kth), QUERIES)]
        reach = np.where(np.isnan(kth), np.inf, self.space.reach(kth))
        far = lambda part: self.space.distances(self.vectors[part])[:, self.number] - self.radius
        self.meets = [(far(part) <= reach[part, None]).any(axis=0) for part in self.tiles]

    def compare(self) -> None:
        """What waits against all queries."""
        if self.queries:
            self._ready()
        t, self.waiting, self.rows = pa.Table.from_batches(self.waiting), [], 0
        ids = t.column("_cid").combine_chunks()
        cid, cell, vectors = ids.to_numpy(zero_copy_only=False), np.searchsorted(self.number, t.column("_cell").to_numpy()), _stack(t.column("_v").combine_chunks())
        self.ids.append(ids)
        qid = self.qid.to_numpy(zero_copy_only=False)
        for part, meets in zip(self.tiles, self.meets):
            rows = np.flatnonzero(meets[cell])
            if len(rows):
                limit = self.sign * self.limit[part]
                some = (slice(None) if len(rows) == len(cid) else rows)
                at_q, at_c, value = _local_topk(qid[part], self.vectors[part], cid[some], vectors[some], self.k, self.space.metric, self.exclude_self, limit)
                if len(at_q):
                    self._merge(part, at_q, self.seen + rows[at_c], self.sign * value)
        self.seen += len(cid)

    def _merge(self, part: slice, at_q: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        """The best K of each query by value and, as ids come in order, by position."""
        k, best, old = self.k, self.best[part], self.at[part]
        q, own = np.unique(at_q, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(q)), k), own])
        value, at = np.concatenate([best[q].ravel(), value]), np.concatenate([old[q].ravel(), at])
        order = np.lexsort((at, value, row))
        count = k + np.bincount(own)
        first = order[(np.cumsum(count) - count)[:, None] + np.arange(k)]
        best[q], old[q] = value[first], at[first]
        self.limit[part] = np.minimum(self.limit[part], best[:, -1])

    def found(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        if self.waiting:
            self.compare()
        ids = pa.chunked_array(self.ids).combine_chunks() if self.ids else None
        for part in self.tiles if self.ids and self.seen and not self.queries else []:
            best, at = self.best[part], self.at[part]
            row, rank = np.nonzero(np.isfinite(best))
            yield pa.RecordBatch.from_arrays([
                self.qid.take(pa.array(part.start + row)), ids.take(pa.array(at[row, rank])), pa.array(self.sign * best[row, rank]), pa.array((rank + 1).astype(np.int32)),
            ], names=names)


def knn_pruned(
    queries: DataFrame, corpus: DataFrame, *, k: int, query_id: str, corpus_id: str, query_vec: str = "embedding", corpus_vec: str = "embedding",
    metric: str = "l2", exclude_self: bool = False, block_rows: int = DEFAULT_BLOCK_ROWS, out_id: str = "neighbor_id", out_score: str | None = None,
    cell_rows: int = 512, counted: dict | None = None,
) -> DataFrame:
    """``[query_id, rank, out_id, score]``: ``knn_join`` without keys and payload.

    ``cell_rows`` is the size of cell aimed at.  ``counted`` gets the number of (query, cell)
    pairs met and of all there are."""
    spark = queries.sparkSession
    score = out_score or ("distance" if metric == "l2" else "score")
    short = {df.schema[vec].dataType.simpleString() for df, vec in ((queries, query_vec), (corpus, corpus_vec))} == {"array<float>"}
    held = "array<float>" if short else "array<double>"
    c = corpus.where(_usable(corpus_vec, metric)).select(F.col(corpus_id).alias("_cid"), F.col(corpus_vec).cast(held).alias("_cv"))
    q = queries.where(_usable(query_vec, metric)).select(F.col(query_id).alias("_qid"), F.col(query_vec).cast(held).alias("_qv"))
    space = _Space(pivots(c, "_cid", "_cv", cell_rows), metric)
    shared = spark.sparkContext.broadcast(space)

    def nearest(vec: str):
        """Rows with the cell that their vector is nearest to (``_cell``) and how far its pivot is."""

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for a in range(0, whole.num_rows, TILE):
                    batch = whole.slice(a, TILE)
                    far = shared.value.distances(_stack(batch.column(vec)))
                    cell = far.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], names=[*batch.schema.names, "_cell", "_far"])

        return lambda df: df.mapInArrow(deal, df.select("*", F.lit(0).alias("_cell"), F.lit(0.0).alias("_far")).schema)

    order = F.col("_score").asc() if metric == "l2" else F.col("_score").desc()
    best = Window.partitionBy("_qid").orderBy(order, F.col("_cid").asc())
    if not len(space.pivots):
        none = q.join(c.withColumn("_score", F.lit(0.0)), F.lit(False)).withColumn("rank", F.row_number().over(best))
        return none.select(F.col("_qid").alias(query_id), "rank", F.col("_cid").alias(out_id), F.col("_score").alias(score))
    dealt = cut(nearest("_cv")(c), "cells")
    cells = dealt.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_far").alias("radius")).orderBy("_cell").toPandas().rename(columns={"_cell": "cell"})
    sign = 1 if metric == "l2" else -1
    need = k + int(exclude_self)

    # cells travel in bundles of about a block: a query goes once to all of a bundle's cells that it meets
    bundle = max(1, min(62, block_rows * len(cells) // max(1, int(cells["n"].sum()))))
    local_schema = q.select("_qid", F.lit(0.0).alias("_value"), F.lit(True).alias("_full")).schema

    def local(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Of each query the K-th value (times ``sign``), or all values where there are fewer."""
        none = pd.DataFrame({f.name: pd.Series(dtype="object") for f in local_schema.fields})
        if not len(left) or not len(right):
            return none
        qv, cv = (np.stack(side.to_numpy()).astype(np.float64) for side in (left["_qv"], right["_cv"]))
        qid, cid, cell, bits = left["_qid"].to_numpy(), right["_cid"].to_numpy(), right["_number"].to_numpy(), left["_bits"].to_numpy()
        at, value = [np.zeros(0, np.int64)], [np.zeros(0)]
        for number in np.unique(cell):
            a, b = np.flatnonzero(bits >> np.int64(number % bundle) & 1), np.flatnonzero(cell == number)
            if len(a):
                at_q, _, found = _local_topk(qid[a], qv[a], cid[b], cv[b], k, metric, exclude_self)
                at.append(a[at_q])
                value.append(sign * found)
        at, value = np.concatenate(at), np.concatenate(value)
        if not len(at):
            return none
        by = np.lexsort((value, at))
        at, value = at[by], value[by]
        count = np.bincount(at, minlength=len(qid))
        rank = np.arange(len(at)) - (np.cumsum(count) - count)[at]
        full = count[at] >= k
        kept = ~full | (rank == k - 1)
        return pd.DataFrame({"_qid": qid[at[kept]], "_value": value[kept], "_full": full[kept]})

    def near(visiting: DataFrame) -> DataFrame:
        """A bound of the K-th score of each query that meets K rows."""
        visiting = cut(visiting, "visits-near")
        guests = visiting.groupBy("_cell").agg(F.count("*").alias("g"), F.sum(F.bit_count("_bits")).alias("met")).toPandas()  # a row a bundle
        if counted is not None:
            counted["met"] = counted.get("met", 0) + int(guests["met"].sum())
        sizes = cells.assign(cell=cells["cell"] // bundle).groupby("cell", as_index=False)["n"].sum().merge(guests, left_on="cell", right_on="_cell")
        blocks = lambda n: [max(1, -(-int(x) // block_rows)) for x in n]
        table = spark.createDataFrame(list(zip(map(int, sizes["cell"]), blocks(sizes["n"]), blocks(sizes["g"]))), "_cell int, _nbc int, _nbq int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        salt = lambda i, n: F.pmod(F.xxhash64(i), F.col(n)).cast("int")
        a = visiting.join(F.broadcast(table), "_cell").withColumn("_qblk", salt("_qid", "_nbq")).withColumn("_cblk", upto("_nbc"))
        b = dealt.select("_cid", "_cv", F.col("_cell").alias("_number"), F.floor(F.col("_cell") / bundle).cast("int").alias("_cell")).join(F.broadcast(table), "_cell").withColumn("_cblk", salt("_cid", "_nbc")).withColumn("_qblk", upto("_nbq"))
        at = ["_cell", "_qblk", "_cblk"]
        found = a.select(*at, "_qid", "_qv", "_bits").groupBy(*at).cogroup(b.select(*at, "_cid", "_cv", "_number").groupBy(*at)).applyInPandas(local, local_schema)
        # repeated ids have one bound between them, that of the first k of all: a query without one meets all cells
        few = F.get(F.sort_array(F.collect_list(F.when(~F.col("_full"), F.col("_value")))), F.lit(k - 1))
        return found.groupBy("_qid").agg((sign * F.coalesce(F.min(F.when(F.col("_full"), F.col("_value"))), few)).alias("_kth"))

    asking = cut(nearest("_qv")(q).drop("_far"), "queries")
    homes = asking.groupBy("_cell").agg(F.count("*").alias("n")).orderBy("_cell").toPandas()
    total = int(homes["n"].sum())
    if counted is not None:
        counted["all"] = total * len(cells)
    rows = max(1, block_rows * DIMENSIONS // max(DIMENSIONS, space.pivots.shape[1]))
    blocks = max(1, -(-total // (BLOCKS * rows)), min(BLOCKS, -(-total // rows)))
    starts = (homes["n"].cumsum() - homes["n"]).tolist()
    place = spark.createDataFrame([(int(x), int(n), int(s)) for x, n, s in zip(homes["_cell"], homes["n"], starts)], "_cell int, _n long, _start long")
    block = F.floor((F.col("_start") + F.pmod(F.xxhash64("_qid", "_qv"), F.col("_n"))) * blocks / total).cast("int").alias("_block")
    kth = near(visits(asking.select("_qid", "_qv", F.lit(None).cast("double").alias("_kth")), space, cells, need, True, bundle))
    asking = asking.join(F.broadcast(place), "_cell").select("_qid", "_qv", "_cell", block)
    asking = cut(asking.join(kth.hint("merge"), "_qid", "left"), "asking")
    met = visits(asking.select("_block", "_qv", "_kth"), space, cells, need, False, bundle, True, ("_block",))
    met = met.groupBy("_block", "_cell").agg(F.bit_or("_bits").alias("bits"), F.sum(F.bit_count("_bits")).alias("met")).toPandas()
    if counted is not None:
        counted["met"] += int(met["met"].sum())
    goes: dict[int, list[int]] = {}
    for number, at, bits in zip(met["_block"], met["_cell"], met["bits"]):
        for i in range(bundle):
            if int(bits) >> i & 1:
                goes.setdefault(int(at) * bundle + i, []).append(int(number))
    table = spark.createDataFrame(list(goes.items()), "_cell int, _blocks array<int>")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    kinds = {f.name: f.dataType for f in [*q.schema.fields, *c.schema.fields]}
    asks = asking.select("_block", F.lit(True).alias("_asks"), "_qid", "_kth", none(kinds["_cid"], "_cid"), "_cell", F.col("_qv").alias("_v"))
    offers = dealt.join(F.broadcast(table), "_cell").select(F.explode("_blocks").alias("_block"), F.lit(False).alias("_asks"), none(kinds["_qid"], "_qid"), none("double", "_kth"), "_cid", "_cell", F.col("_cv").alias("_v"))
    numbers = (cells["cell"].to_numpy(), cells["radius"].to_numpy())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, here = None, None
        for batch in batches:
            of = batch.column("_block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if here is None or of[a] != now:
                        if here is not None:
                            yield from here.found(names)
                        now, here = of[a], _Block(shared.value, numbers, k, exclude_self)
                    here.add(batch.slice(a, b - a))
        if here is not None:
            yield from here.found(names)

    names = ["_qid", "_cid", "_score", "rank"]
    schema = asks.select("_qid", "_cid", F.lit(0.0).alias("_score"), F.lit(0).alias("rank")).schema
    both = asks.unionByName(offers).repartitionById(blocks, "_block").sortWithinPartitions("_block", F.col("_asks").desc(), "_cid")
    ranked = both.mapInArrow(compare, schema)
    if not asking.groupBy("_qid").count().where("count > 1").isEmpty():
        # rows of one id share its K
        ranked = ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("_qid").alias(query_id), "rank", F.col("_cid").alias(out_id), F.col("_score").alias(score))
