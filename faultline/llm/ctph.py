"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes sets piece boundaries: a position is one at
level k where the hash ends in k zero bits, so pieces of level k + 1 are unions
of pieces of level k and an edit changes only the pieces it touches.  A
fingerprint names the first level with at most 64 pieces and holds the
signatures (one character a piece, from the piece's checksum) of this level and
the two above it.  Two fingerprints are compared at each level both have, by the
edit distance of their signatures (insertions and deletions), and must share a
run of pieces; the best level counts.

``edits`` needs each text's successor in the order of ids.  Rows are dealt out by
ranges of (id, hash of the text, arrival), which splits a frequent id too, and a
task walks its range in order; only the last text of a range needs another
range's first, and meets it by a join on the range's number.

Defined results: a null text is ''.  The successor is the next row by id (null
first), then by the text's hash, so repeated ids and rows follow each other; the
last row's is the first, and a single row is its own.  The empty text has the
fingerprint ``0:::``; two equal fingerprints have likeness 1, others without a
common level or run 0.  Very long texts are read whole.  Other columns, of any
name, are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import _text
from faultline.llm._cut import cut

WINDOW = 7
MOST = 64  # pieces in a signature
LEVELS = 3  # signatures in a fingerprint
RUN = 4  # pieces in a row that likeness asks for (half the shorter signature where that is less)
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _tables() -> list[np.ndarray]:
    """Value of a byte at each place of the window: its mixed value turned by the place."""
    value = (_text.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    return [(value << np.uint32(t)) | (value >> np.uint32(32 - t)) if t else value for t in range(WINDOW)]


_TABLES = _tables()
_PAD = b"\0" * WINDOW


def levels(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, offset behind the byte, level) of every byte that ends a piece at level 1 or above."""
    data = np.frombuffer(_PAD + _PAD.join(texts), dtype=np.uint8)
    roll = np.zeros(len(data), dtype=np.uint32)
    for t, table in enumerate(_TABLES):
        roll[WINDOW:] ^= table[data[WINDOW - t:len(data) - t]]
    size = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.cumsum(size + WINDOW) - size
    at = np.flatnonzero((roll & np.uint32(1)) == 0)
    row = np.searchsorted(first, at, "right") - 1
    inside = (row >= 0) & (at < (first + size)[row])
    at, row = at[inside], row[inside]
    low = roll[at] & (~roll[at] + np.uint32(1))  # the lowest bit that is set; 0 if none is
    level = np.where(low == 0, 32, np.log2(np.maximum(low, 1)).astype(np.int64))
    return row, at - first[row] + 1, level


def fingerprints(texts: list[bytes]) -> list[str]:
    if not texts:
        return []
    row, stop, level = levels(texts)
    n = len(texts)
    # boundaries at level k or above, per text: the first level with fewer than MOST is the base
    held = np.bincount(row * 33 + level, minlength=33 * n).reshape(n, 33)[:, ::-1].cumsum(axis=1)[:, ::-1]
    base = np.argmax(held[:, 1:] < MOST, axis=1) + 1
    used = level >= base[row]
    row, stop, level = row[used], stop[used], level[used]
    cuts = np.searchsorted(row, np.arange(n + 1)).tolist()
    stops, tops, base = stop.tolist(), level.tolist(), base.tolist()
    crc = zlib.crc32
    out = []
    for i, text in enumerate(texts):
        if not text:
            out.append("0" + ":" * LEVELS)
            continue
        view, x, y = memoryview(text), cuts[i], cuts[i + 1]
        signatures = []
        for k in range(base[i], base[i] + LEVELS):
            a, signature = 0, []
            for b, top in zip(stops[x:y], tops[x:y]):
                if top >= k:
                    signature.append(LETTERS[crc(view[a:b]) & 63])
                    a = b
            if a < len(text):
                signature.append(LETTERS[crc(view[a:]) & 63])
            signatures.append("".join(signature))
        out.append(":".join([str(base[i]), *signatures]))
    return out


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits: the edit distance without
    replacement is ``len(a) + len(b) - 2 * common(a, b)``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def likeness(x: str, y: str) -> float:
    """1 less the edit distance of the signatures over their lengths, at the best common level."""
    if x == y:
        return 1.0
    one, other = x.split(":"), y.split(":")
    shift = int(other[0]) - int(one[0])
    best = 0.0
    for k in range(max(0, shift), min(LEVELS, LEVELS + shift)):
        a, b = one[1 + k], other[1 + k - shift]
        run = min(RUN, -(-min(len(a), len(b)) // 2))
        if run and not {a[i:i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i:i + run] for i in range(len(b) - run + 1)):
            best = max(best, 2 * common(a, b) / (len(a) + len(b)))
    return best


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of every whole text (a column of that name is replaced)."""
    keep = [c for c in df.columns if c != out]
    schema = df.select(*keep, F.lit("").cast("string").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in _text.chunks(batch, text):
                raw, cuts = data.tobytes(), offs.tolist()
                prints = fingerprints([raw[x:y] for x, y in zip(cuts, cuts[1:])])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in keep), pa.array(prints, pa.string())], names=[*keep, out])

    return df.mapInArrow(run, schema)


EDITED = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _judged(ids: list, texts: list[str], following: list[str], prints: list[str] | None = None) -> list[pa.Array]:
    """The columns of EDITED for texts with their successors."""
    changed = [edited(t, f).encode() for t, f in zip(texts, following)]
    if prints is None:
        prints = fingerprints([t.encode() for t in [*texts, *following]])
    else:
        prints = [*prints[:-1], *prints[1:]]
    own, after, other = prints[:len(texts)], prints[len(texts):], fingerprints(changed)
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
        pa.array(own, pa.string()), pa.array(other, pa.string()),
        pa.array([likeness(x, y) for x, y in zip(own, other)], pa.float64()), pa.array([likeness(x, y) for x, y in zip(own, after)], pa.float64()),
    ]


def edits(df: DataFrame, id_col: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Fingerprints of every whole text, of its edited text (see ``edited``), and the
    likeness of the text's to the edited text's and to its successor's."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    key = ["id", "hash", "arrival"]
    rows = rows.select("id", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("arrival"), "text")
    ranges = rows.repartitionByRange(n, *key).sortWithinPartitions(*key).select("id", "text")
    names = [c.split()[0] for c in EDITED.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        held: tuple | None = None  # the last row seen, which waits for its successor

        def edge(kind: int, row: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([kind], pa.int32()), pa.array([number], pa.int32()), pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.string()),
                *(pa.nulls(1, t) for t in (pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2)),
            ], names=["kind", "part", "id", "text", *names[1:]])

        for batch in batches:
            for a, b, _, _ in _text.chunks(batch, "text"):
                ids, texts = (batch.column(c).slice(a, b - a).to_pylist() for c in ("id", "text"))
                if held is None:
                    yield edge(1, (ids[0], texts[0]))
                    before = []
                else:
                    before = [held]
                prints = fingerprints([t.encode() for t in texts])
                ids, texts, prints = [*(h[0] for h in before), *ids], [*(h[1] for h in before), *texts], [*(h[2] for h in before), *prints]
                held = (ids[-1], texts[-1], prints[-1])
                if len(texts) > 1:
                    done = _judged(ids[:-1], texts[:-1], texts[1:], prints)
                    k = len(texts) - 1
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.zeros(k, np.int32)), pa.array(np.full(k, number, np.int32)), done[0], pa.nulls(k, pa.string()), *done[1:],
                    ], names=["kind", "part", "id", "text", *names[1:]])
        if held is not None:
            yield edge(2, held)

    schema = "kind int, part int, id long, text string, " + EDITED.split(", ", 1)[1]
    made = cut(ranges.mapInArrow(walk, schema), "edits")
    # the ranges that hold rows, in order: one number each
    parts = [r.part for r in made.where("kind = 1").select("part").orderBy("part").collect()]
    last = made.where("kind = 2").select("part", "id", "text")
    if parts:
        follows = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]])), "part int, next int")
        heads = made.where("kind = 1").select(F.col("part").alias("next"), F.col("text").alias("following"))
        last = last.join(follows, "part").join(heads, "next")
    else:
        last = last.withColumn("following", F.col("text"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays(_judged(*(one.column(c).to_pylist() for c in ("id", "text", "following"))), names=names)

    rest = last.select("id", "text", "following").mapInArrow(finish, EDITED)
    return made.where("kind = 0").select(*names).unionByName(rest).withColumnRenamed("id", id_col)
