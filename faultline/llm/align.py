"""Cross-tokenizer alignment by diagonal run skipping.

Two tokenizers cut the same bytes; their tokens are aligned where both end.
Where ``ends_a[i] == ends_b[i + shift]`` goes on for a while, tokens match one
to one, and doubling probes at that shift jump over the stretch; its exact end
is found by halving.  What doesn't match is walked token by token up to the
next offset where both end, which gives the new shift.

Batches of texts are encoded and aligned in Python workers; what stands between two
blanks is encoded once as long as a worker remembers it, since neither tokenizer
joins it with what stands outside.  What needs the
whole corpus, the number of documents that hold an id pair linked, goes
through Spark: a block of documents sends each of its distinct pairs once, so a
pair that stands in every document is one row a block, and the counts come
back to the blocks by a join on the pair.

Defined results: a null or empty text, or one that a tokenizer doesn't give
back byte by byte, has no tokens: zeros, no groups, no links.  Very long texts
are aligned whole.  Rows are kept as they are: a repeated row, a repeated or a
null id, is a document of its own each time.  Further columns of any name are
kept by ``align`` (those named like its results are replaced) and ignored by
``report``.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm import _text
from faultline.llm._cut import cut
from faultline.llm.bpe import Memo, byte_alphabet

BLOCK = 1 << 22  # bytes of text that share one list of distinct pairs
MEMO = 400_000  # parts of texts in each generation that a worker remembers
SPACE_MARK = "▁"  # fixed by the piece file's format: a space
# White space on both sides of a blank: A's rule for runs of it reads across the blank.
BLANK = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TIED = f"{BLANK} {BLANK}"
EDGE = f"^{BLANK}|{BLANK}$"
RUN = 500  # parts that are read as one text


def align_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and links of two token sequences over the same bytes, given as end
    offsets: for each group the number of A and B tokens up to its end, and
    the token pairs (A index, B index) whose bytes overlap."""
    n = len(ends_a)
    ends_a, ends_b = ends_a.astype(np.int64), ends_b.astype(np.int64)
    # ends as bytes, so a probe is one comparison of memory; both sides end at the same offset
    a, b = ends_a.tobytes(), ends_b.tobytes()
    at_a, at_b = memoryview(a).cast("q"), memoryview(b).cast("q")
    irregular: list[int] = []  # of each such group: where it begins on both sides, and where the next one does
    note = irregular.extend
    i = j = 0
    while i < n:
        x, y = at_a[i], at_b[j]
        if x == y:
            # known to match: ``low`` tokens; double the probe while it holds
            low, p, q = 1, 8 * i, 8 * j
            while i + low < n:
                if a[p + 8 * low:p + 16 * low] != b[q + 8 * low:q + 16 * low]:
                    high = 2 * low
                    while high - low > 1:
                        mid = (low + high) // 2
                        if a[p + 8 * low:p + 8 * mid] == b[q + 8 * low:q + 8 * mid]:
                            low = mid
                        else:
                            high = mid
                    break
                low += low
            i += low
            j += low
        else:
            begin, other = i, j
            while x != y:
                if x < y:
                    i += 1
                    x = at_a[i]
                else:
                    j += 1
                    y = at_b[j]
            i += 1
            j += 1
            note((begin, other, i, j))
    from_a, from_b, to_a, to_b = np.array(irregular, dtype=np.int64).reshape(-1, 4).T

    def inside(first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
        turn = np.zeros(size + 1, dtype=np.int64)
        turn[first] += 1
        np.subtract.at(turn, last, 1)
        return np.cumsum(turn[:-1]) > 0

    odd_a, odd_b = inside(from_a, to_a, n), inside(from_b, to_b, len(ends_b))
    one_a, one_b = np.flatnonzero(~odd_a), np.flatnonzero(~odd_b)
    odd_a, odd_b = np.flatnonzero(odd_a), np.flatnonzero(odd_b)
    # in irregular groups every piece between two ends is a link
    end_a, end_b = ends_a[odd_a], ends_b[odd_b]
    ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
    ends = ends[np.diff(ends, prepend=-1) > 0]
    return (
        np.sort(np.concatenate([one_a + 1, to_a])), np.sort(np.concatenate([one_b + 1, to_b])),
        np.concatenate([one_a, odd_a[np.searchsorted(end_a, ends)]]), np.concatenate([one_b, odd_b[np.searchsorted(end_b, ends)]]),
    )


def load(byte_bpe_path: str, piece_path: str) -> dict:
    """Both vocabulary files, read once on the driver; their size doesn't depend on the corpus."""
    with open(byte_bpe_path, "rb") as f, open(piece_path, "rb") as g:
        a, b = f.read(), g.read()
    return {"name": hashlib.sha256(a + b).hexdigest(), "a": a, "b": b}


class Tokenizers:
    """The two tokenizers of a worker, with the bytes of every token."""

    def __init__(self, spec: dict):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(spec["a"].decode())
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=spec["b"])
        byte = {c: i for i, c in enumerate(byte_alphabet())}
        vocab = self.a.get_vocab(with_added_tokens=True)
        names: list[str | None] = [None] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            names[i] = t
        raw_a = [bytes(byte[c] for c in t) if t and all(c in byte for c in t) else (t or "").encode() for t in names]
        size_b = self.b.get_piece_size()
        raw_b = [
            bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i)
            else self.b.id_to_piece(i).replace(SPACE_MARK, " ").encode() for i in range(size_b)
        ]
        self.raw = [raw_a, raw_b]
        self.size = [np.array([len(t) for t in raw], dtype=np.int64) for raw in (raw_a, raw_b)]
        # ids as text with what may follow: A tokens "," or "|" (last of its group), B tokens "," or ";"
        self.names = pa.array(
            [f"{i}{c}" for i in range(len(raw_a)) for c in ",|"] + [f"{i}{c}" for i in range(size_b) for c in ",;"],
            pa.large_binary(),
        )
        self.first_b = 2 * len(raw_a)

        # no piece goes on behind a blank, so B reads what stands between blanks alone
        self.by_part = not any(SPACE_MARK in t.lstrip(SPACE_MARK) for t in map(self.b.id_to_piece, range(size_b)))
        self.memo = Memo(MEMO)

    def encode(self, parts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Both sides' ids (32 bits each) of a space and a part each; None for a part that a
        side doesn't give back byte by byte.

        Parts without white space at their ends are put together again, many a call,
        and the ids are dealt out by the parts' bytes."""
        out: list = [None] * len(parts)
        edge = pc.match_substring_regex(pa.array(parts, pa.large_string()), EDGE).to_pylist()
        joint = [k for k, t in enumerate(parts) if self.by_part and t and not edge[k]]
        done = set()
        for first in range(0, len(joint), RUN):
            some = joint[first:first + RUN]
            ids = self._run([parts[k] for k in some])
            if ids is not None:
                done.update(some)
                for k, x in zip(some, ids):
                    out[k] = x
        rest = [k for k in range(len(parts)) if k not in done]
        spaced = [" " + parts[k] for k in rest]
        for k, t, a, b in zip(rest, spaced, self.a.encode_batch_fast(spaced, add_special_tokens=False), self.b.encode([parts[k] for k in rest], num_threads=1)):
            a, want = a.ids, t.encode()
            if all(b"".join(map(raw.__getitem__, ids)) == want for raw, ids in zip(self.raw, (a, b))):
                out[k] = np.array(a, np.int32).tobytes(), np.array(b, np.int32).tobytes()
        return out

    def _run(self, parts: list[str]) -> list[tuple[bytes, bytes]] | None:
        """Ids of parts that are read as one text; None if a side doesn't give it back."""
        text = " ".join(parts)
        want = (" " + text).encode()
        stops = np.cumsum([len(t) + 1 for t in (parts if len(want) == len(text) + 1 else map(str.encode, parts))])
        sides = []
        for which, ids in ((0, self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids), (1, self.b.encode(text))):
            got = np.array(ids, dtype=np.int32)
            ends = np.cumsum(self.size[which][got])
            cuts = np.searchsorted(ends, stops)
            if len(ends) != cuts[-1] + 1 or (ends[cuts] != stops).any() or b"".join(map(self.raw[which].__getitem__, ids)) != want:
                return None
            cuts, raw = [0, *(4 * cuts + 4).tolist()], got.tobytes()
            sides.append([raw[x:y] for x, y in zip(cuts, cuts[1:])])
        return list(zip(*sides))


def tokenizers_of(spec: dict) -> Tokenizers:
    if spec["name"] not in _text.KEPT:
        _text.KEPT.clear()
        _text.KEPT[spec["name"]] = Tokenizers(spec)
    return _text.KEPT[spec["name"]]


class Aligned:
    """The alignment of a run of texts: ids and offsets of both sides, groups, links."""

    def __init__(self, tok: Tokenizers, texts: list[str | None]):
        n = len(texts)
        # a text between whose blanks stand parts that don't depend on each other is many parts, another is one
        tied = pc.match_substring_regex(pa.array([t or "" for t in texts], pa.large_string()), TIED).to_pylist()
        cut = [bool(t) and tok.by_part and not (x or t[0] == " " or t[-1] == " " or "  " in t) for t, x in zip(texts, tied)]
        split = pc.split_pattern(pa.array([t if c else "" for t, c in zip(texts, cut)], pa.large_string()), " ")
        size = np.where(cut, pc.list_value_length(split).to_numpy(zero_copy_only=False), [bool(t) for t in texts]).astype(np.int64)
        whole = [k for k, t in enumerate(texts) if t and not cut[k]]
        coded = split.filter(pa.array(cut, pa.bool_())).flatten().dictionary_encode()
        names = coded.dictionary.to_pylist() + [texts[k] for k in whole]
        part = np.empty(int(size.sum()), dtype=np.int64)
        first = np.cumsum(size) - size
        single = np.zeros(len(part), dtype=bool)
        single[first[whole]] = True
        part[~single] = coded.indices.to_numpy(zero_copy_only=False)
        part[single] = np.arange(len(whole)) + len(coded.dictionary)

        new = tok.memo.missing(set(names))
        for piece in range(0, len(new), 5000):
            tok.memo.young.update(zip(new[piece:piece + 5000], tok.encode(new[piece:piece + 5000])))
        found = list(map(tok.memo.young.__getitem__, names))
        lost = np.array([x is None for x in found], dtype=bool)
        row = np.repeat(np.arange(n), size)
        bad = np.zeros(n, dtype=bool)
        bad[row[lost[part]]] = True
        keep = ~bad[row]
        row, part = row[keep], part[keep]
        #: for each text the position of its tokens among those of all texts
        self.ids, self.offs = [], []
        ends = []
        for which in (0, 1):
            lists = [x[which] if x else b"" for x in found]
            flat = np.frombuffer(b"".join(lists), dtype=np.int32).astype(np.int64)
            offs = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))) // 4])
            sizes = np.diff(offs)[part]
            here = np.repeat(offs[part] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            self.ids.append(flat[here])
            self.offs.append(np.concatenate([[0], np.cumsum(_text.per_row(sizes, row, n).astype(np.int64))]))
            ends.append(np.cumsum(tok.size[which][self.ids[which]]))
        # texts end at the same offset on both sides, so no group crosses them
        self.group_a, self.group_b, self.link_a, self.link_b = align_ends(*ends)
        self.groups = np.searchsorted(self.group_a, self.offs[0], "right")

    def digests(self, tok: Tokenizers) -> list[str]:
        """Digest of each text's groups, '' for one without tokens."""
        a, b = self.ids
        last_a, last_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        last_a[self.group_a - 1] = 1
        last_b[self.group_b - 1] = 1
        # an A token stands after the B tokens of earlier groups, a B token after the A tokens up to its group
        of_a, of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before = np.concatenate([[0], self.group_b])
        name = np.empty(len(a) + len(b), dtype=np.int64)
        name[np.arange(len(a)) + before[of_a]] = 2 * a + last_a
        name[np.arange(len(b)) + self.group_a[of_b]] = tok.first_b + 2 * b + last_b
        taken = tok.names.take(pa.array(name))
        raw = memoryview(taken.buffers()[2] or b"")
        offs = np.frombuffer(taken.buffers()[1], dtype=np.int64)[:len(name) + 1]
        at = offs[self.offs[0] + self.offs[1]].tolist()
        return [hashlib.sha256(raw[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(at, at[1:])]


def _lists(values: np.ndarray, offs: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values.astype(np.int32)))


def _pieces(batch: pa.RecordBatch, text: str, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``size`` bytes of text."""
    offs = _text.column(batch, text)[1]
    a = 0
    while a < batch.num_rows:
        b = min(batch.num_rows, max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1))
        yield batch.slice(a, b - a)
        a = b


RESULTS = ("a_ids", "b_ids", "group_a_ends", "group_b_ends")


def align(df: DataFrame, byte_bpe_path: str, piece_path: str, text: str = "text") -> DataFrame:
    """``df`` with the ids of both sides of each whole text (``a_ids``, ``b_ids``)
    and, for each group, the number of tokens up to its end (``group_a_ends``,
    ``group_b_ends``)."""
    spec = df.sparkSession.sparkContext.broadcast(load(byte_bpe_path, piece_path))
    keep = [f.name for f in df.schema.fields if f.name not in RESULTS]
    schema = T.StructType([
        *(f for f in df.schema.fields if f.name in keep),
        *(T.StructField(name, T.ArrayType(T.IntegerType(), False)) for name in RESULTS),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers_of(spec.value)
        for whole in batches:
            for batch in _pieces(whole, text, _text.CHUNK):
                x = Aligned(tok, batch.column(text).to_pylist())
                group = [np.append(0, g)[x.groups] for g in (x.group_a, x.group_b)]
                sizes = np.diff(x.groups)
                ends = [g - np.repeat(s[:-1], sizes) for g, s in zip((x.group_a, x.group_b), group)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in keep), _lists(x.ids[0], x.offs[0]), _lists(x.ids[1], x.offs[1]),
                     _lists(ends[0], x.groups), _lists(ends[1], x.groups)],
                    names=[*keep, *RESULTS],
                )
            _text.tidy()

    return df.mapInArrow(run, schema)


BLOCKS = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("id", T.LongType()),
    *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")), T.StructField("groups_sha256", T.StringType()),
    # of a document: its pairs by their place in the block's list, with the number of links
    T.StructField("at", T.ArrayType(T.IntegerType(), False)), T.StructField("times", T.ArrayType(T.IntegerType(), False)),
    # of a block, in a row of its own: distinct pairs, and how many of its documents hold each
    T.StructField("pairs", T.ArrayType(T.LongType(), False)), T.StructField("docs", T.ArrayType(T.LongType(), False)),
])


def _aligned_blocks(docs: DataFrame, spec) -> DataFrame:
    """One row per document (id, text), and one per block with its distinct pairs ``A id << 32 | B id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, number = tokenizers_of(spec.value), TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in _pieces(whole, "text", BLOCK):
                counts, pair, row, first = [], [], [], 0
                for piece in _pieces(batch, "text", BLOCK):
                    x = Aligned(tok, piece.column("text").to_pylist())
                    owner = np.searchsorted(x.offs[0], x.link_a, "right") - 1
                    pair.append(x.ids[0][x.link_a] << 32 | x.ids[1][x.link_b])
                    row.append(owner + first)
                    counts.append((np.diff(x.offs[0]), np.diff(x.offs[1]), np.diff(x.groups), np.bincount(owner, minlength=piece.num_rows), x.digests(tok)))
                    first += piece.num_rows
                distinct, at = np.unique(np.concatenate(pair), return_inverse=True)
                own, times = np.unique(np.concatenate(row) * len(distinct) + at, return_counts=True)
                size = max(len(distinct), 1)
                row, at = own // size, own % size
                offs = np.searchsorted(row, np.arange(first + 1))
                held = np.bincount(at, minlength=len(distinct))
                columns = [np.concatenate([c[k] for c in counts]) for k in range(4)]
                null = lambda kind, k: pa.nulls(k, kind)
                ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
                names = [f.name for f in BLOCKS.fields]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(first, number)), batch.column("id"), *map(pa.array, columns), pa.array([d for c in counts for d in c[4]], pa.string()),
                    _lists(at, offs), _lists(times, offs), null(longs, first), null(longs, first),
                ], names=names)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), *(null(pa.int64(), 1) for _ in range(5)), null(pa.string(), 1), null(ints, 1), null(ints, 1),
                    pa.array([distinct], longs), pa.array([held], longs),
                ], names=names)
                number += 1
            _text.tidy()

    return docs.mapInArrow(run, BLOCKS)


def report(df: DataFrame, byte_bpe_path: str, piece_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts per document: tokens, groups, links, and how common its links are in the corpus."""
    spec = df.sparkSession.sparkContext.broadcast(load(byte_bpe_path, piece_path))
    made = cut(_aligned_blocks(df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")), spec), "aligned")
    listed = made.where("pairs is not null").select(F.col("block").alias("held_by"), F.posexplode(F.arrays_zip("pairs", "docs")).alias("pos", "x"))
    listed = listed.select("held_by", "pos", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    count = listed.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.expr("shiftright(pair, 32)"))
    highest = count.groupBy("a").agg(F.max("count").alias("highest"))
    known = count.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    answer = listed.select("held_by", "pos", "pair").join(known, "pair").select("held_by", "pos", "count", "best")

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        pos = right.column("pos").to_numpy()
        count, best = np.zeros(len(pos), dtype=np.int64), np.zeros(len(pos), dtype=np.int64)
        count[pos] = right.column("count").to_numpy()
        best[pos] = right.column("best").to_numpy().astype(np.int64)
        at, times = (left.column(c).combine_chunks() for c in ("at", "times"))
        size = np.diff(at.offsets.to_numpy())
        at, times = at.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        stop = np.cumsum(size)
        total = lambda x: np.concatenate([[0], np.cumsum(x)])[stop] - np.concatenate([[0], np.cumsum(x)])[stop - size]
        return pa.table({
            **{c: left.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")},
            "n_best": total(best[at] * times), "count_sum": total(count[at] * times), "groups_sha256": left.column("groups_sha256"),
        })

    found = (
        made.where("pairs is null").drop("pairs", "docs").groupBy("block").cogroup(answer.groupBy("held_by"))
        .applyInArrow(judge, "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    )
    return found.withColumnRenamed("id", id_col)
