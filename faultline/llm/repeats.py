"""Repeated 200-byte strings, by prefix doubling over a sparse set of positions.

Prefix doubling sorts (position, rank) pairs of all positions at growing lengths
until ranks are unique or long enough.  Over every byte that is about 20 times
the input for each round, so the positions are thinned out first, without loss:
in each window of ``LENGTH`` bytes the smallest hash of its ``SEED``-byte strings
marks one position, its anchor.  Equal windows have their anchor at the same
offset, so only windows of anchors that agree have to be compared.

Round 1 ranks anchors by the SEED bytes that begin there, and, where those
occur again, by ``REACH`` bytes more to the right, to the left, and by all bytes
that any of its windows can hold.  An anchor with a unique rank drops out (both
longer ranks must be unique for that, since a window reaches at least so far on
one side); one whose whole surroundings occur again needs no more, all its
windows are repeated.  Round 2 ranks the windows of the rest at full length.

Ranks are 64-bit hashes; equal strings meet in the partition of their hash, as
packed rows.  A hash that many positions of one batch share is dealt out
further, by longer strings or by single windows, so no partition grows with a
hot passage.  Equal documents count once and are repeated as a whole.

Defined results: a null text is empty; a text shorter than ``LENGTH`` bytes keeps
all; repeated rows are copies of each other, so each loses all its bytes if it
has LENGTH or more; matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import _text
from faultline.llm._cut import cut
from faultline.llm._filter import bitmap, holds

LENGTH, SEED, REACH = 200, 40, 80
SPAN = LENGTH - SEED  # largest offset of an anchor in its window
CROWD = 64
RECORD = 38  # bytes of a round-1 record: ranks of 6, 8, 6, 6 bytes, document 8, position 4
RANK = 7  # bytes of a round-2 rank
ROWS_EACH = 2_000_000  # anchors that one partition should get
# Flags of an anchor.
WHOLE, RIGHT, LEFT, SHOWN, HOT = 1, 2, 4, 8, 16


def anchors(data: np.ndarray, offs: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, ...]:
    """(position, first window, last window, row) of every anchor of a chunk."""
    n = len(data)
    none = np.zeros(0, np.int64)
    size = np.diff(offs)
    big = size >= LENGTH
    if not big.any():
        return none, none, none, none
    at = np.arange(n - SEED + 1)
    # the upper half of the hash orders positions, the lower half says which it is
    low = (_text.span_hash(prefix, at, at + SEED) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    step = 1
    while 2 * step <= SPAN + 1:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    rest = SPAN + 1 - step
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, offs[:-1][big], 1)
    np.add.at(edge, offs[1:][big] - LENGTH + 1, -1)
    window = np.flatnonzero(np.cumsum(edge[:n]) > 0)
    p = (low[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    last = np.append(first[1:], len(p)) - 1
    return p[first], window[first], window[last], np.searchsorted(offs, p[first], "right") - 1


def within(prefix: np.ndarray, offs: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of [a, b), 0 where that leaves the row."""
    ok = (a >= offs[row]) & (b <= offs[row + 1])
    return np.where(ok, _text.span_hash(prefix, np.where(ok, a, 0), np.where(ok, b, 0)) | np.uint64(1), np.uint64(0))


def _raw(x: np.ndarray, width: int) -> np.ndarray:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _number(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :raw.shape[1]] = raw
    return out.view("<u8").ravel()


def _binary(cuts: np.ndarray, raw: bytes) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(raw)])


def _cuts(x: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal values."""
    if not len(x):
        return np.zeros(1, np.int64)
    return np.append(np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])), len(x))


def _times(*keys: np.ndarray) -> np.ndarray:
    """How often each combination of keys occurs."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    size = np.diff(np.append(np.flatnonzero(new), len(order)))
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.repeat(size, size)
    return out


def _owners(node: np.ndarray, parts: int) -> np.ndarray:
    return (_text.mix(node.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _round1(docs: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_all = batch.column("doc").to_numpy()
            seen: set[int] = set()
            for a, b, data, offs in _text.chunks(batch, "text", 1 << 20):
                doc = doc_all[a:b]
                fresh = np.array([not (d in seen or seen.add(d)) for d in doc.tolist()], dtype=bool)
                prefix = _text.prefix_hash(data)
                p, _, _, row = anchors(data, offs, prefix)
                mine = fresh[row]
                p, row = p[mine], row[mine]
                if not len(p):
                    continue
                seed = _text.span_hash(prefix, p, p + SEED)
                hull = within(prefix, offs, row, p - SPAN, p + LENGTH)
                right = within(prefix, offs, row, p, p + SEED + REACH)
                left = within(prefix, offs, row, p - REACH, p + SEED)
                crowd = _times(seed) >= CROWD
                part = ((seed >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)
                raw = np.hstack([_raw(seed, 6), _raw(hull, 8), _raw(right, 6), _raw(left, 6), _raw(doc[row].view(np.uint64), 8), _raw((p - offs[row]).astype(np.uint64), 4)])
                groups = [(~crowd, part, 0)]
                if crowd.any():
                    hot = np.flatnonzero(crowd)
                    # one of them stands for the hash in its own partition; the others are dealt out by their surroundings
                    stand = np.zeros(len(p), dtype=bool)
                    stand[hot[np.unique(seed[hot], return_index=True)[1]]] = True
                    far = np.where(hull > 0, _text.mix(seed ^ hull), _text.mix(doc[row].view(np.uint64) + p.astype(np.uint64)))
                    groups += [(stand, part, 1), (crowd, (far % np.uint64(parts)).astype(np.int64), 2)]
                for chosen, to, kind in groups:
                    if chosen.any():
                        order = np.argsort(to[chosen], kind="stable")
                        cuts = _cuts(to[chosen][order])
                        yield pa.RecordBatch.from_arrays([
                            pa.array(to[chosen][order][cuts[:-1]].astype(np.int32)), pa.array(np.full(len(cuts) - 1, kind, np.int32)), _binary(cuts * RECORD, raw[chosen][order].tobytes()),
                        ], names=["part", "kind", "rows"])

    return docs.mapInArrow(run, "part int, kind int, rows binary").repartitionById(parts, "part")


def _judge(raw: np.ndarray, stand: np.ndarray, hot: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, position, flag) of the anchors that stay after round 1."""
    seed, hull, right, left = _number(raw[:, :6]), _number(raw[:, 6:14]), _number(raw[:, 14:20]), _number(raw[:, 20:26])
    doc, at = _number(raw[:, 26:34]).view(np.int64), _number(raw[:, 34:38]).astype(np.int64)
    order = np.lexsort((~stand, at, doc, seed))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (seed[order][1:] != seed[order][:-1]) | (doc[order][1:] != doc[order][:-1]) | (at[order][1:] != at[order][:-1])
    keep = order[new]
    seed, hull, right, left, doc, at, stand = (x[keep] for x in (seed, hull, right, left, doc, at, stand))
    flag = np.zeros(len(seed), dtype=np.int64)
    whole = (hull > 0) & (_times(seed, hull) > 1)
    if hot:
        flag[:] = HOT | RIGHT | LEFT
        open_group = np.ones(len(seed), dtype=bool)
    else:
        # a hash that a batch dealt out has more holders than are seen here
        _, group = np.unique(seed, return_inverse=True)
        dealt = np.bincount(group, weights=stand)[group] > 0
        several = (_times(seed) > 1) | dealt
        flag[(right > 0) & ((_times(seed, right) > 1) | dealt)] |= RIGHT
        flag[(left > 0) & ((_times(seed, left) > 1) | dealt)] |= LEFT
        flag[dealt] |= HOT
        flag[~several] = 0
        whole &= several
        # in a group where some anchor is still open, here or among those dealt out, one of each surroundings shows its windows
        open_group = dealt | (np.bincount(group, weights=(flag & (RIGHT | LEFT) > 0) & ~whole)[group] > 0)
    flag[whole] = (flag[whole] & HOT) | WHOLE
    w = np.flatnonzero(whole & open_group)
    if len(w):
        order = w[np.lexsort((hull[w], seed[w]))]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (seed[order][1:] != seed[order][:-1]) | (hull[order][1:] != hull[order][:-1])
        flag[order[new]] |= SHOWN
    stays = (flag & (WHOLE | RIGHT | LEFT)) > 0
    return doc[stays], at[stays], flag[stays]


def _state(packed: DataFrame, parts: int) -> DataFrame:
    """(doc, at, flag): for each document that has any, the anchors that stay."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[bool, list] = {False: [], True: []}
        for batch in batches:
            kind = batch.column("kind").to_pylist()
            for k, rows in zip(kind, batch.column("rows").to_pylist()):
                raw = np.frombuffer(rows, dtype=np.uint8).reshape(-1, RECORD)
                got[k == 2].append((raw, np.full(len(raw), k == 1)))
        for hot, found in got.items():
            if found:
                raw, stand = np.vstack([x for x, _ in found]), np.concatenate([x for _, x in found])
                found.clear()
                doc, at, flag = _judge(raw, stand, hot)
                to = _owners(doc, parts)
                order = np.argsort(to, kind="stable")
                cuts = _cuts(to[order])
                lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x[order])) for x in (doc, at.astype(np.int32), flag.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(to[order][cuts[:-1]].astype(np.int32)), *lists], names=["to", "doc", "at", "flag"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [tuple(b.column(c).flatten().to_numpy() for c in ("doc", "at", "flag")) for b in batches if b.num_rows]
        if found:
            doc, at, flag = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((at, doc))
            doc, at, flag = doc[order], at[order], flag[order]
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])]))
            doc, at, flag = doc[first], at[first], np.bitwise_or.reduceat(flag, first)
            cuts = _cuts(doc)
            lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x)) for x in (at, flag)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[cuts[:-1]]), *lists], names=["doc", "at", "flag"])

    moved = packed.mapInArrow(judge, "to int, doc array<long>, at array<int>, flag array<int>").repartitionById(parts, "to")
    return moved.mapInArrow(gather, "doc long, at array<int>, flag array<int>")


def _staying(batch: pa.RecordBatch, a: int, b: int, data: np.ndarray, offs: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, ...]:
    """(position, first window, last window, row, flag) of a chunk's anchors that stayed."""
    p, first, last, row = anchors(data, offs, prefix)
    at, flag = batch.column("at").slice(a, b - a), batch.column("flag").slice(a, b - a)
    size = np.diff(at.offsets.to_numpy())
    mine = np.repeat(offs[:-1], size) + at.flatten().to_numpy()  # ordered, as anchors are
    kept = np.isin(p, mine, assume_unique=True)
    return p[kept], first[kept], last[kept], row[kept], flag.flatten().to_numpy()


def _round2(marked: DataFrame, parts: int) -> DataFrame:
    """Windows of open anchors, and of those that show theirs, dealt by anchor."""
    names = ["part", "doc", "start", "n", "ask", "known", "ranks"]

    def pack(part, doc, start, n, ask, known, raw) -> pa.RecordBatch:
        order = np.argsort(part, kind="stable")
        part = part[order]
        cuts = _cuts(part)
        size = np.where(known, 0, n)
        begin = np.cumsum(size) - size
        total = size[order]
        pick = np.repeat(begin[order], total) + np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x[order])) for x in (doc, start.astype(np.int32), n.astype(np.int32), ask, known)]
        ends = np.append(0, np.cumsum(total))[cuts] * RANK
        return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), *lists, _binary(ends, raw[pick].tobytes())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_all = batch.column("doc").to_numpy()
            for a, b, data, offs in _text.chunks(batch, "text", 1 << 20):
                prefix = _text.prefix_hash(data)
                p, first, last, row, flag = _staying(batch, a, b, data, offs, prefix)
                doc = doc_all[a:b]
                show = ((flag & WHOLE) == 0) | ((flag & SHOWN) > 0)
                p, first, last, row, flag = (x[show] for x in (p, first, last, row, flag))
                # offsets up to REACH reach right far enough for RIGHT, others left for LEFT
                open_ = (flag & WHOLE) == 0
                first = np.where(open_ & ((flag & LEFT) == 0), np.maximum(first, p - REACH), first)
                last = np.where(open_ & ((flag & RIGHT) == 0), np.minimum(last, p - REACH), last)
                some = last >= first
                p, first, last, row, flag, open_ = (x[some] for x in (p, first, last, row, flag, open_))
                if not len(p):
                    continue
                n = last - first + 1
                each = np.repeat(np.arange(len(p)), n)
                window = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                rank = _text.span_hash(prefix, window, window + LENGTH)
                hot = (flag & HOT) > 0
                cold = ~hot
                if cold.any():
                    part = ((_text.span_hash(prefix, p, p + SEED) >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)[cold]
                    yield pack(part, doc[row[cold]], (first - offs[row])[cold], n[cold], open_[cold], np.zeros(cold.sum(), bool), _raw(rank[cold[each]], RANK))
                if hot.any():
                    e, w, r = each[hot[each]], window[hot[each]], rank[hot[each]]
                    # windows that occur twice here are repeated; one of them tells the others
                    times = _times(r)
                    _, once = np.unique(r, return_index=True)
                    ask = open_[e] & (times == 1)
                    owner, start = doc[row[e]], w - offs[row[e]]
                    one = np.ones(len(once), dtype=np.int64)
                    yield pack((r[once] % np.uint64(parts)).astype(np.int64), owner[once], start[once], one, ask[once], np.zeros(len(once), bool), _raw(r[once], RANK))
                    known = np.flatnonzero(open_[e] & (times > 1))
                    if len(known):
                        yield pack(_owners(owner[known], parts), owner[known], start[known], np.ones(len(known), np.int64), np.ones(len(known), bool), np.ones(len(known), bool), np.zeros((0, RANK), np.uint8))

    return marked.mapInArrow(run, "part int, doc array<long>, start array<int>, n array<int>, ask array<boolean>, known array<boolean>, ranks binary").repartitionById(parts, "part")


def _spans(packed: DataFrame, parts: int) -> DataFrame:
    """(doc, begin, stop): for each document the runs of its repeated windows of open anchors, by first and last start."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, raw = [], []
        for b in batches:
            if b.num_rows:
                found.append(tuple(b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("doc", "start", "n", "ask", "known")))
                raw += b.column("ranks").to_pylist()
        if not found:
            return
        doc, start, n, ask, known = (np.concatenate(x) for x in zip(*found))
        out = [(doc[known], start[known].astype(np.int64), start[known].astype(np.int64))]
        doc, start, n, ask = doc[~known], start[~known], n[~known], ask[~known]
        rank = _number(np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(-1, RANK))
        raw.clear()
        each = np.repeat(np.arange(len(doc)), n)
        at = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        # equal documents stand in several batches: a window counts once for each place
        order = np.lexsort((at, doc[each], rank))
        r, d, s = rank[order], doc[each][order], at[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (r[1:] != r[:-1]) | (d[1:] != d[:-1]) | (s[1:] != s[:-1])
        _, group = np.unique(r, return_inverse=True)
        again = np.zeros(len(order), dtype=bool)
        again[order] = np.bincount(group, weights=new)[group] > 1
        hit = np.flatnonzero(again & ask[each])
        if len(hit):
            e, s = each[hit], at[hit].astype(np.int64)
            head = np.concatenate([[True], (e[1:] != e[:-1]) | (s[1:] != s[:-1] + 1)])
            tail = np.append(head[1:], True)
            out.append((doc[e[head]], s[head], s[tail]))
        doc, begin, stop = (np.concatenate(x) for x in zip(*out))
        if len(doc):
            to = _owners(doc, parts)
            order = np.argsort(to, kind="stable")
            cuts = _cuts(to[order])
            lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x[order])) for x in (doc, begin, stop)]
            yield pa.RecordBatch.from_arrays([pa.array(to[order][cuts[:-1]].astype(np.int32)), *lists], names=["to", "doc", "begin", "stop"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [tuple(b.column(c).flatten().to_numpy() for c in ("doc", "begin", "stop")) for b in batches if b.num_rows]
        if found:
            doc, begin, stop = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((stop, begin, doc))
            doc, begin, stop = doc[order], begin[order], stop[order]
            cuts = _cuts(doc)
            lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x)) for x in (begin, stop)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[cuts[:-1]]), *lists], names=["doc", "begin", "stop"])

    moved = packed.mapInArrow(judge, "to int, doc array<long>, begin array<long>, stop array<long>").repartitionById(parts, "to")
    return moved.mapInArrow(gather, "doc long, begin array<long>, stop array<long>")


def _stripped(marked: DataFrame) -> DataFrame:
    """(doc, n_removed, n_spans, kept): the rest of each text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_all = batch.column("doc").to_numpy()
            for a, b, data, offs in _text.chunks(batch, "text", 1 << 20):
                prefix = _text.prefix_hash(data)
                _, first, last, _, flag = _staying(batch, a, b, data, offs, prefix)
                whole = (flag & WHOLE) > 0
                begin, stop = batch.column("begin").slice(a, b - a), batch.column("stop").slice(a, b - a)
                base = np.repeat(offs[:-1], pc.fill_null(pc.list_value_length(begin), 0).to_numpy())
                cover = np.zeros(len(data) + 1, dtype=np.int64)
                np.add.at(cover, np.concatenate([first[whole], base + begin.flatten().to_numpy()]), 1)
                np.add.at(cover, np.concatenate([last[whole], base + stop.flatten().to_numpy()]) + LENGTH, -1)
                gone = np.cumsum(cover[:-1]) > 0
                n, spans, kept = [], [], []
                for i in range(b - a):
                    g = gone[offs[i]:offs[i + 1]]
                    n.append(int(g.sum()))
                    spans.append(int((g[1:] & ~g[:-1]).sum() + (g[:1].sum())))
                    kept.append(data[offs[i]:offs[i + 1]][~g].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(doc_all[a:b]), pa.array(n, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc", "n_removed", "n_spans", "kept"])

    return marked.mapInArrow(run, "doc long, n_removed long, n_spans long, kept binary")


def strip(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: (id, doc, n_bytes, copies, sha256) of every row, with ``doc`` the hash of its text and
    ``copies`` how many rows have that text; and (doc, n_removed, n_spans, kept) of
    every text that holds an anchor which occurs again, judged apart from its own copies."""
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("doc", F.xxhash64("text"))
    rows = read.select("id", "doc", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256"))
    count = rows.groupBy("doc").agg(F.count("*").alias("copies"), F.first("n_bytes").alias("n"))
    count = cut(count, "texts")
    total = count.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // (80 * ROWS_EACH)) + 1)
    texts = read.select("doc", "text")
    state = cut(_state(_round1(texts, parts), parts), "anchors")
    bits = spark.sparkContext.broadcast(bitmap(state, "doc"))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("doc").to_numpy()
            once = np.zeros(len(doc), dtype=bool)
            once[np.unique(doc, return_index=True)[1]] = True
            yield batch.filter(pa.array(once & holds(bits.value, doc)))

    marked = cut(texts.mapInArrow(wanted, texts.schema).join(state, "doc"), "marked")
    spans = _spans(_round2(marked, parts), parts)
    left = _stripped(marked.join(spans, "doc", "left"))
    return rows.join(count.select("doc", "copies"), "doc"), left


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    rows, left = strip(docs, id_col, text)
    left = left.select("doc", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")).dropDuplicates(["doc"])
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    return rows.join(left, "doc", "left").select(
        F.col("id").alias(id_col), "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )
