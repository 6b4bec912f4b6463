"""N-gram Jaccard join by universe partitioning and the pigeonhole principle.

A document's set is its distinct five-word shingles (hashed to 64 bits).  Two
sets of n and m elements with a similarity of ``NUM / DEN`` or more differ in at
most H = (n + m)(DEN - NUM) // (DEN + NUM) elements.  For every band of sizes the
hashed universe is cut into a little more than H segments; each differing
element spoils one segment at most, so a linked pair agrees on some segment of
any H + 1 of them, or, where a segment may differ by one element, counts it
double.  Every set is indexed by its segments' contents, and for every eighth
segment by the contents with one element left out, in its own band and, if a
larger partner can be there, in the next one.  Sets under ``SMALL`` elements use
their elements as segments.

Allocation by cost: after one exchange by key, a set knows which of its keys are
shared and by how many.  It takes the H + 1 cheapest units: unshared keys are
free, and a set with enough of those has no partner to look for.  Only the rest
of the keys yield candidates, which are verified on the whole sets.

Links are only followed as far as components need.  The sets under a key are
first verified against one of them, the one that shares most keys.  Keys whose
sets then still lie in several components connect these to families; inside a
family all but its largest component are compared with the whole, in blocks that
yield a link for each set and never candidates, so no component is missed.

Equal sets are one node from the start.  A key that many sets of one batch share
is dealt out by batch, with one set to stand for them in the key's own
partition, so no partition grows with a hot group; whether its holders lie in
several components is judged over all of them.  A set too unevenly spread
over the segments to fill its H + 1 units is joined through all its elements.

Defined results: without words or text a document has an empty set, links with
nothing and is its own component; null ids take part in links but never name a
component; repeated rows are kept, each with its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import _text
from faultline.llm._components import components, within_block
from faultline.llm._cut import cut
from faultline.llm._filter import bitmap, holds

WIDTH = 5
NUM, DEN = 75, 100
SMALL = 32
SLACK = 1.2
ELEMENTS = 1_000_000  # of a block
ROWS = 4096  # sets of a block: short texts are many sets of few elements
CROWD = 64  # sets of one batch under one key from which the key is dealt out by batch
KEYS_EACH = 300_000  # keys that one partition should get
BYTES = 5  # of a key within its partition
NO_PROBE = -(1 << 30)


def most_apart(n: int) -> int:
    """The largest symmetric difference of a set of n elements and a linked one that isn't larger."""
    return 2 * n * (DEN - NUM) // (DEN + NUM)


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ordered by row and hash."""
    low = _text.LOWER[data]
    start, end, row = _text.words(low, offs)
    w = _text.span_hash(_text.prefix_hash(low), start, end)
    n = len(offs) - 1
    found, rows = [], []

    def fold(columns: list[np.ndarray]) -> np.ndarray:
        h = _text.mix(columns[0] + np.uint64(len(columns)))
        for c in columns[1:]:
            h = _text.mix(h + c)
        return h

    if len(w) >= WIDTH:
        whole = np.flatnonzero(row[WIDTH - 1:] == row[:len(row) - WIDTH + 1])
        found.append(fold([w[whole + k] for k in range(WIDTH)]))
        rows.append(row[whole])
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    for c in range(1, WIDTH):
        short = np.flatnonzero(count == c)
        if len(short):
            found.append(fold([w[first[short] + k] for k in range(c)]))
            rows.append(short)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, r = np.concatenate(found), np.concatenate(rows)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])
    return h[new], r[new]


def _nodes(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and hash (0 for none) of each row's set."""
    size = np.bincount(row, minlength=n)
    total = np.zeros(n, dtype=np.uint64)
    if len(h):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        total[row[first]] = _text.mix(np.add.reduceat(_text.mix(h), first) + size[row[first]].astype(np.uint64)) | np.uint64(1)
    return size, total


def _spread(h: np.ndarray, row: np.ndarray, size: np.ndarray, need: np.ndarray, band: int) -> Iterator[tuple]:
    """(key, row, need, unit) of sets in a band: whole segments, then those with one element left out.

    ``unit``: -1, or twice the number of a segment that may differ, plus 1 where an element is left out.
    ``need``: H + 1 for sets that search; units are taken off."""
    if band == 0:
        need = need - size
        yield _text.mix(h ^ np.uint64(0x51ED270B)), row, need[row], np.full(len(h), -1)
        return
    top = (2 << band) - 1
    m = int(np.ceil((most_apart(top) + 1) * SLACK))
    loose = max(1, m // 8)
    segment = (_text.mix(h ^ np.uint64(0xA5A5 + band)) % np.uint64(m)).astype(np.int64)
    value = _text.mix(h + np.uint64(0x2545F491))
    group = row * m + segment
    order = np.argsort(group, kind="stable")
    group, value = group[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    q = np.diff(np.append(first, len(group)))
    total = np.add.reduceat(value, first)
    row, segment = group[first] // m, group[first] % m
    salt = _text.mix((segment + 1).astype(np.uint64) + np.uint64(band << 32))
    named = lambda content, q, salt: _text.mix(_text.mix(content + q.astype(np.uint64)) ^ salt)
    out = (segment < loose) & (q >= 2)
    need = need - np.bincount(row, minlength=len(size)) - np.bincount(row[out], minlength=len(size))
    yield named(total, q, salt), row, need[row], np.where(out, segment * 2, -1)
    each = np.repeat(np.arange(len(first)), q)
    inner = out[each]
    each = each[inner]
    yield named(total[each] - value[inner], q[each] - 1, salt[each]), row[each], need[row[each]], segment[each] * 2 + 1


def index(h: np.ndarray, row: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, row, need, unit) of all keys; need is NO_PROBE where a set only waits to be found."""
    n = len(size)
    safe = np.maximum(size, 1)
    band = np.where(size < SMALL, 0, np.floor(np.log2(safe)).astype(np.int64))
    reach = safe * DEN // NUM  # the largest linked partner
    above = np.where(reach < SMALL, 0, np.floor(np.log2(reach)).astype(np.int64))
    parts = []
    for search in (True, False):
        for b in np.unique(band if search else above[above > band]):
            chosen = (band == b) if search else (above == b) & (above > band)
            mine = chosen[row]
            if not mine.any():
                continue
            need = np.array(size) * 2 * (DEN - NUM) // (DEN + NUM) + 1
            for key, r, left, unit in _spread(h[mine], row[mine], np.where(chosen, size, 0), need, int(b)):
                parts.append((key, r, left if search else np.full(len(r), NO_PROBE), unit))
    if not parts:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    return tuple(np.concatenate(x) for x in zip(*parts))


def _lists(to: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    to = pa.array(to.astype(np.int32))
    return [pa.ListArray.from_arrays(to, pa.array(v)) for v in values]


def sets(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, content, n, node) of every row; ``content`` is a hash of the text."""
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in _text.chunks(batch, "text"):
                n, node = _nodes(*shingles(data, offs), b - a)
                own = [batch.column(c).slice(a, b - a) for c in ("id", "content")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n.astype(np.int64)), pa.array(node.view(np.int64))], names=["id", "content", "n", "node"])

    return read.mapInArrow(run, f"id {kind}, content long, n long, node long")


PACKED = "part int, keys binary, node array<long>, need array<int>, unit array<int>, home array<int>, crowded boolean"


def _indexed(docs: DataFrame, text: str, parts: int) -> DataFrame:
    def pack(key: np.ndarray, node: np.ndarray, need: np.ndarray, unit: np.ndarray, part: np.ndarray, home: np.ndarray | None) -> pa.RecordBatch:
        """``home``: the keys' own partitions, where others than these are given."""
        crowded = home is not None
        order = np.argsort(part, kind="stable")
        key, node, need, unit, part = (x[order] for x in (key, node, need, unit, part))
        cuts = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part))
        short = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()
        keys = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * BYTES).astype(np.int32).tobytes()), pa.py_buffer(short)])
        lists = _lists(cuts, node.view(np.int64), need.astype(np.int32), unit.astype(np.int32))
        lists += _lists(cuts if crowded else np.zeros(len(cuts)), home[order].astype(np.int32) if crowded else np.zeros(0, np.int32))
        return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), keys, *lists, pa.array(np.full(len(cuts) - 1, crowded))], names=["part", "keys", "node", "need", "unit", "home", "crowded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for _, b, data, offs in _text.chunks(batch, text):
                h, row = shingles(data, offs)
                size, node = _nodes(h, row, len(offs) - 1)
                # one row of each set in the batch
                _, once = np.unique(node, return_index=True)
                once = np.array([i for i in once.tolist() if size[i] and not (int(node[i]) in seen or seen.add(int(node[i])))], dtype=np.int64)
                mine = np.zeros(len(size), dtype=bool)
                mine[once] = True
                h, row = h[mine[row]], row[mine[row]]
                key, row, need, unit = index(h, row, np.where(mine, size, 0))
                if not len(key):
                    continue
                part = ((key >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(key, kind="stable")
                same = np.concatenate([[True], key[order][1:] != key[order][:-1]])
                count = np.diff(np.append(np.flatnonzero(same), len(order)))
                crowd = np.zeros(len(key), dtype=bool)
                crowd[order] = np.repeat(count >= CROWD, count)
                stand = np.zeros(len(key), dtype=bool)
                stand[order[same]] = count >= CROWD
                if crowd.any():
                    salt = _text.mix(np.array([int(node[once[0]])], dtype=np.uint64))[0]
                    dealt = (_text.mix(key[crowd] ^ salt) % np.uint64(parts)).astype(np.int64)
                    yield pack(key[crowd], node[row[crowd]], need[crowd], unit[crowd], dealt, part[crowd])
                    plain = ~crowd | stand
                    yield pack(key[plain], node[row[plain]], need[plain], unit[plain], part[plain], None)
                else:
                    yield pack(key, node[row], need, unit, part, None)

    return docs.select(text).mapInArrow(run, PACKED).repartitionById(parts, "part")


def _shared(packed: DataFrame, parts: int) -> DataFrame:
    """(to, key, node, need, unit, size, home): packed rows of the keys that two sets or more have, dealt by set.

    ``home``: for a key that a batch dealt out, the key as the other batches know it; empty for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = {True: [], False: []}
        mine = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            mine = batch.column("part")[0].as_py()
            crowded = batch.column("crowded").to_numpy(zero_copy_only=False)
            for flag in (True, False):
                rows = batch.filter(pa.array(crowded == flag))
                if rows.num_rows:
                    raw = np.frombuffer(b"".join(rows.column("keys").to_pylist()), dtype=np.uint8).reshape(-1, BYTES)
                    key = np.zeros((len(raw), 8), dtype=np.uint8)
                    key[:, :BYTES] = raw
                    key = key.view("<u8").ravel()
                    # keys are told apart across partitions by their own partition
                    own = rows.column("home").flatten().to_numpy().astype(np.uint64) if flag else np.uint64(mine)
                    key = _text.mix(key + (own + np.uint64(1) << np.uint64(40)))
                    got[flag].append((key, *(rows.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("node", "need", "unit"))))
        for flag, found in got.items():
            if not found:
                continue
            key, node, need, unit = (np.concatenate(x) for x in zip(*found))
            found.clear()
            order = np.lexsort((need == NO_PROBE, node, key))
            key, node, need, unit = key[order], node[order], need[order], unit[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
            key, node, need, unit = key[new], node[new], need[new], unit[new]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            size = np.repeat(size, size)
            several = size > 1
            key, node, need, unit, size = key[several], node[several], need[several], unit[several], size[several]
            home = key
            if flag:
                key = _text.mix(key ^ _text.mix(np.array([mine + 1], dtype=np.uint64)))
            to = (_text.mix(node.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.append(np.flatnonzero(np.concatenate([[True], to[order][1:] != to[order][:-1]])), len(to)) if len(to) else np.zeros(1, np.int64)
            if len(to):
                lists = _lists(cuts, *(x[order] for x in (key.view(np.int64), node, need.astype(np.int32), unit.astype(np.int32), size.astype(np.int64))))
                lists += _lists(cuts if flag else np.zeros(len(cuts)), home[order].view(np.int64) if flag else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(to[order][cuts[:-1]].astype(np.int32)), *lists], names=["to", "key", "node", "need", "unit", "size", "home"])
            del key, home, node, need, unit, size, to, order, new, first, several
        _text.tidy()

    return packed.mapInArrow(run, "to int, key array<long>, node array<long>, need array<int>, unit array<int>, size array<long>, home array<long>")


def _allocated(shared: DataFrame, parts: int) -> DataFrame:
    """(key, node, degree, short): the shared keys of the units that each set takes, with the
    sum of its keys' sizes; ``short`` marks a set whose units don't make up H + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for b in batches:
            if b.num_rows:
                found.append(tuple(b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("key", "node", "need", "unit", "size")))
        if not found:
            return
        key, node, need, unit, size = (np.concatenate(x) for x in zip(*found))
        probe = need != NO_PROBE
        key, node, need, unit, size = (x[probe] for x in (key, node, need, unit, size))
        if not len(key):
            return
        order = np.lexsort((key, unit, node))
        key, node, need, unit, size = (x[order] for x in (key, node, need, unit, size))
        # a unit: one whole key, or all keys of a segment with one element left out
        own = np.concatenate([[True], (node[1:] != node[:-1]) | (unit[1:] != unit[:-1]) | (unit[1:] % 2 == 0) | (unit[1:] < 0)])
        at = np.cumsum(own) - 1
        first = np.flatnonzero(own)
        cost = np.bincount(at, weights=size)
        owner, left, code = node[first], need[first], unit[first]
        # leaving an element out only counts after the whole segment does
        after = np.zeros(len(first), dtype=bool)
        after[1:] = (code[1:] % 2 == 1) & (code[1:] > 0) & (owner[1:] == owner[:-1]) & (code[:-1] == code[1:] - 1)
        cost[after] = np.maximum(cost[after], cost[np.flatnonzero(after) - 1])
        order = np.lexsort((np.arange(len(first)), cost, owner))
        owner_o = owner[order]
        start = np.flatnonzero(np.concatenate([[True], owner_o[1:] != owner_o[:-1]]))
        count = np.diff(np.append(start, len(order)))
        rank = np.arange(len(order)) - np.repeat(start, count)
        take = np.zeros(len(first), dtype=bool)
        take[order] = rank < left[order] + np.repeat(count, count)
        degree = np.repeat(np.add.reduceat(cost[order], start), count)
        full = np.zeros(len(first))
        full[order] = degree
        chosen = take[at]
        yield pa.RecordBatch.from_arrays([pa.array(key[chosen]), pa.array(node[chosen]), pa.array(full[at][chosen].astype(np.int64)), pa.array(need[chosen] > 0)], names=["key", "node", "degree", "short"])
        del key, node, need, unit, size, order, own, at, cost, owner, left, code
        _text.tidy()

    return shared.repartitionById(parts, "to").mapInArrow(run, "key long, node long, degree long, short boolean")


def _elements(nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(node, elements): the whole sets of the nodes, and of some others, each once."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(nodes, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for _, _, data, offs in _text.chunks(batch, text):
                h, row = shingles(data, offs)
                size, node = _nodes(h, row, len(offs) - 1)
                hit = holds(bits.value, node) & (size > 0)
                rows = [i for i in np.flatnonzero(hit).tolist() if not (int(node[i]) in seen or seen.add(int(node[i])))]
                mine = np.zeros(len(size), dtype=bool)
                mine[rows] = True
                to = np.append(0, np.cumsum(size[mine]))
                yield pa.RecordBatch.from_arrays([pa.array(node[mine].view(np.int64)), *_lists(to, h[mine[row]].view(np.int64))], names=["node", "elements"])

    return docs.select(text).mapInArrow(run, "node long, elements array<long>").dropDuplicates(["node"])


def _verified(pairs: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The pairs (a, b) of nodes that are linked, by the intersection of their whole sets."""
    whole = cut(_elements(pairs.select(F.explode(F.array("a", "b")).alias("node")), docs, text), "sets")
    x = whole.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    y = whole.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    size = F.greatest(F.size("x"), F.size("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(x, "a").join(y, "b")
        .where(DEN * F.least(F.size("x"), F.size("y")) >= NUM * size)
        .where(DEN * both >= NUM * (F.size("x") + F.size("y") - both)).select("a", "b")
    )


def common(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix) of the intersection sizes of left and right sets, some left rows at a time.

    Elements that many right sets hold are multiplied as a matrix, the others are
    looked up one by one."""
    n = np.array([len(y) for y in right])
    element, row = np.concatenate(right), np.repeat(np.arange(len(right)), n)
    order = np.argsort(element, kind="stable")
    element, row = element[order], row[order]
    names, first, count = np.unique(element, return_index=True, return_counts=True)
    often = np.flatnonzero(count > 64)
    column = np.full(len(names), -1)
    column[often] = np.arange(len(often))
    wide = np.zeros((len(right), len(often)), dtype=np.float32)
    for k in range(0, len(often), 4096):
        part = often[k:k + 4096]
        each = np.repeat(part, count[part])
        at = np.repeat(first[part], count[part]) + np.arange(len(each)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
        wide[row[at], column[each]] = 1
    for i in range(0, len(left), 128):
        sets_ = left[i:i + 128]
        x, owner = np.concatenate(sets_), np.repeat(np.arange(len(sets_)), [len(s) for s in sets_])
        at = np.minimum(np.searchsorted(names, x), len(names) - 1)
        held = names[at] == x
        at, owner = at[held], owner[held]
        out = np.zeros((len(sets_), len(right)), dtype=np.int64)
        if len(often):
            m = np.zeros((len(sets_), len(often)), dtype=np.float32)
            hot = column[at] >= 0
            m[owner[hot], column[at[hot]]] = 1
            out += np.rint(m @ wide.T).astype(np.int64)
            at, owner = at[~hot], owner[~hot]
        each = np.repeat(np.arange(len(at)), count[at])
        hit = first[at[each]] + np.arange(len(each)) - np.repeat(np.cumsum(count[at]) - count[at], count[at])
        out += np.bincount(owner[each] * len(right) + row[hit], minlength=out.size).reshape(out.shape)
        yield i, out


def _across(here: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Links (a, b) between components that still share a key, compared in blocks.

    ``here``: key, node, component.  Sets connected by such keys form a family.  All
    its sets but those of its largest component are compared with the whole family,
    in bands of size that a link can span; a band is dealt into blocks by its numbers
    of elements and of sets, so a pair of blocks has a bounded product, and each pair of blocks yields one edge a linked set at most."""
    low = here.groupBy("key").agg(F.min("node").alias("b"))
    family = components(here.join(low, "key").select(F.col("node").alias("a"), "b"))
    each = here.select("node", "component").distinct().join(family.withColumnRenamed("component", "family"), "node")
    most = each.groupBy("family", "component").count().groupBy("family").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    each = each.join(most, "family").select("family", "node", "component", (F.col("component") != F.col("main")).alias("asks"))
    band = F.floor(F.log(F.size("elements")) / F.log(F.lit(DEN / NUM)) + 1e-9).cast("int")
    whole = cut(each.join(_elements(each, docs, text), "node").withColumn("band", band), "family")
    asks = whole.where("asks").withColumn("at", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    offers = whole.withColumn("at", F.col("band"))
    key = ["family", "at"]

    def blocks(df: DataFrame, name: str) -> DataFrame:
        by = F.greatest(F.ceil(F.sum(F.size("elements")) / ELEMENTS), F.ceil(F.count("*") / ROWS))
        return df.groupBy(*key).agg(by.cast("int").alias(name))

    count = blocks(asks, "nq").join(blocks(offers, "nc"), key)
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ("node", "component", "elements")
    x = asks.join(count, key).withColumn("q", block("nq")).select(*key, "q", every("nc").alias("c"), *cols)
    y = offers.join(count, key).withColumn("c", block("nc")).select(*(F.col(k).alias(k) for k in key), every("nq").alias("q"), "c", *(F.col(c).alias(c) for c in cols))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a = b = np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            (na, ga), (nb, gb) = ((t.column("node").to_numpy(), t.column("component").to_numpy()) for t in (left, right))
            sets_ = [[v.values.to_numpy() for v in t.column("elements")] for t in (left, right)]
            size = [np.array([len(v) for v in s]) for s in sets_]
            linked = np.zeros((len(na), len(nb)), dtype=bool)
            for i, both in common(*sets_):
                rows = slice(i, i + len(both))
                linked[rows] = (DEN * both >= NUM * (size[0][rows, None] + size[1] - both)) & (ga[rows, None] != gb)
            rows, cols = linked.any(axis=1), linked.any(axis=0)
            if rows.any():
                na, nb = na[rows], nb[cols]
                la, lb = within_block(linked[np.ix_(rows, cols)], na, nb)
                a, b = np.concatenate([na, nb]), np.concatenate([la, lb])
        return pa.table({"a": a, "b": b})

    grp = [*key, "q", "c"]
    return x.groupBy(*grp).cogroup(y.groupBy(*grp)).applyInArrow(run, "a long, b long").where("a <> b").distinct()


def _by_elements(short: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Candidates of sets that can't fill their units: all sets that share an element with them."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(short, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in _text.chunks(batch, text):
                h, row = shingles(data, offs)
                size, node = _nodes(h, row, len(offs) - 1)
                hit = holds(bits.value, node)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(node[row].view(np.int64)), pa.array(hit[row])], names=["h", "node", "own"])

    elements = docs.select(text).mapInArrow(run, "h long, node long, own boolean").distinct()
    left = elements.where("own").join(short.select("node").distinct(), "node").select("h", F.col("node").alias("a"))
    return left.join(elements.select("h", F.col("node").alias("b")), "h").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(docs: DataFrame, text: str = "text", keys: int = 0) -> DataFrame:
    """(node, component) of the sets that link with another one; ``keys``: about how many keys there are."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys // KEYS_EACH))
    shared = cut(_shared(_indexed(docs, text, parts), parts), "shared")
    taken = cut(_allocated(shared, parts), "taken")
    # who stands under the keys that somebody takes; a key that was dealt out is taken in all its parts
    crowds = cut(shared.where(F.size("home") > 0).select(F.explode(F.arrays_zip("key", "home")).alias("x")).select("x.key", "x.home").distinct(), "crowds")
    wanted = taken.select("key").distinct().join(crowds, "key", "left").select(F.coalesce("home", "key").alias("home")).distinct()
    wanted = wanted.select(F.col("home").alias("key"), F.lit(None).cast("long").alias("home")).unionByName(crowds.join(wanted, "home"))
    members = shared.select(F.explode(F.arrays_zip("key", "node")).alias("x")).select("x.key", "x.node")
    members = members.join(wanted, "key").join(taken.groupBy("node").agg(F.max("degree").alias("degree")), "node", "left")
    members = cut(members.select("key", "home", "node", F.coalesce("degree", F.lit(0)).alias("degree")), "members")

    short = taken.where("short").select("node").distinct()
    edges = spark.createDataFrame([], "a long, b long")
    if not short.isEmpty():
        edges = cut(_verified(_by_elements(short, docs, text), docs, text), "links")
    # each key's members against the one that shares most keys
    centre = members.groupBy("key").agg(F.max_by("node", F.struct("degree", F.xxhash64("node"))).alias("c"))
    stars = members.join(centre, "key").where("node <> c").select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()
    edges = cut(edges.unionByName(_verified(cut(stars, "pairs"), docs, text)), "links")
    group = cut(components(edges), "components")
    # whether a key is split shows over all its holders, those that were dealt out included
    here = members.select(F.coalesce("home", "key").alias("key"), "node").join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    here = cut(here.select("key", "node", "component"), "here")
    split = here.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    here = cut(here.join(split, "key", "left_semi"), "split")
    if here.isEmpty():
        return group
    return components(edges.unionByName(_across(here, docs, text)))


def _grouped(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``sets``, and (node, component) of every set that isn't empty."""
    rows = cut(sets(docs, id_col, text), "rows")
    total = rows.agg(F.sum("n")).first()[0] or 0
    group = rows.where("n > 0").select("node").distinct().join(links(docs, text, total // 2), "node", "left")
    return rows, group.withColumn("component", F.coalesce("component", "node"))


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    rows, group = _grouped(docs, id_col, text)
    own = rows.where("n > 0").groupBy("node").agg(F.min("id").alias("least")).join(group, "node")
    named = own.select("node", "component").join(own.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    return rows.join(named, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: that with the smallest id, one without an id
    only if there is no other (of several texts under one id the one with the smaller
    hash).  Documents without words all stay; rows that repeat an id and text are one document."""
    rows, group = _grouped(docs, id_col, text)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "content")).alias("x")
    least = rows.where("n > 0").groupBy("node").agg(first).join(group, "node").groupBy("component").agg(F.min("x").alias("x")).select("x.id", "x.content")
    stay = least.unionByName(rows.where("n = 0").select("id", "content").distinct()).select(F.col("id").alias("__id"), F.col("content").alias("__c"))
    here = docs.withColumns({"__row": F.col(id_col), "__content": F.xxhash64(text)})
    kept = here.join(stay, F.col("__row").eqNullSafe(F.col("__id")) & (F.col("__content") == F.col("__c")), "left_semi")
    return kept.dropDuplicates(["__row", "__content"]).select(*docs.columns)
