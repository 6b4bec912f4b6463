"""BPE encoding and decoding with a public vocabulary file.

Each word is merged through a segment tree over the ranks of its adjacent
pairs: the root names the leftmost pair of the lowest rank, a merge changes
three leaves, and each change climbs one path, so a word of n symbols takes
O(n log n).  Words repeat, so a worker keeps the results of recent ones in a
table of bounded size.

The vocabulary is read once on the driver from the path given and broadcast;
its size is fixed by the file (49k entries here), whatever the corpus.

Defined results: a null or blank text has no ids and decodes to ''; a null id
list decodes to ''; rows and their other columns, repeats included, are kept
as they are.
"""

from __future__ import annotations

import gc
import hashlib
import itertools
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm._text import KEPT, tidy

NO_PAIR = 1 << 40
MEMO = 130_000  # words, and as many runs between blanks, in each generation that a worker remembers
# Fixed by the vocabulary's format: white space that it folds to one blank.
BLANKS = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
NOT_BLANK = "\x1c\x1d\x1e\x1f"  # blanks to str.split, but not here


class PairTree:
    """Segment tree over pair ranks; ``lowest()`` is the leftmost minimum."""

    def __init__(self, ranks: list[int]):
        self.size = size = 1 << max(0, (len(ranks) - 1).bit_length())
        self.node = node = [NO_PAIR] * size + ranks + [NO_PAIR] * (size - len(ranks))
        for i in range(size - 1, 0, -1):
            x, y = node[2 * i], node[2 * i + 1]
            node[i] = x if x < y else y

    def set(self, i: int, rank: int) -> None:
        node, i = self.node, i + self.size
        if node[i] == rank:
            return
        node[i] = rank
        while i > 1:
            other = node[i ^ 1]
            if other < rank:
                rank = other
            i >>= 1
            if node[i] == rank:
                return
            node[i] = rank

    def lowest(self) -> int:
        """Position of the leftmost pair of lowest rank, -1 if none is left."""
        node, size = self.node, self.size
        low = node[1]
        if low == NO_PAIR:
            return -1
        i = 1
        while i < size:
            i += i
            if node[i] != low:
                i += 1
        return i - size


def merge(symbols: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """Apply merges, lowest rank first and leftmost first among equals.  ``ranks``
    has the rank of a pair ``left << 20 | right``, ``made`` the symbol it becomes."""
    n = len(symbols)
    if n < 2:
        return symbols
    rank = ranks.get
    tree = PairTree([rank(a << 20 | b, NO_PAIR) for a, b in zip(symbols, symbols[1:])])
    if tree.node[1] == NO_PAIR:
        return symbols
    sym = list(symbols)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    put, lowest, node = tree.set, tree.lowest, tree.node
    while (i := lowest()) >= 0:
        j = nxt[i]
        sym[i] = new = made[node[1]]
        sym[j] = -1
        nxt[i] = k = nxt[j]
        if k < n:
            prv[k] = i
            put(j, NO_PAIR)
            put(i, rank(new << 20 | sym[k], NO_PAIR))
        else:
            put(i, NO_PAIR)
        if (h := prv[i]) >= 0:
            put(h, rank(sym[h] << 20 | new, NO_PAIR))
    return [s for s in sym if s >= 0]


def merge_all(words: list[list[int]], keys: np.ndarray, rank: np.ndarray, made: np.ndarray) -> list[list[int]]:
    """``merge`` of many words at once: words with trees of one size are merged in
    step, one pair each.  ``keys`` are the sorted pairs, ``rank`` their ranks."""
    out: list = [None] * len(words)
    by_size: dict[int, list[int]] = {}
    for w, symbols in enumerate(words):
        if len(symbols) < 2:
            out[w] = symbols
        else:
            by_size.setdefault(1 << (len(symbols) - 2).bit_length(), []).append(w)

    def ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = (a << 20) | b
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        return np.where((keys[at] == pair) & (a >= 0) & (b >= 0), rank[at], NO_PAIR)

    for size, chosen in by_size.items():
        step = max(1, (1 << 17) // size)
        for part in (chosen[k:k + step] for k in range(0, len(chosen), step)):
            n, width = len(part), size + 2
            length = np.array([len(words[w]) for w in part])
            at = np.arange(width)
            sym = np.full((n, width), -1, dtype=np.int64)
            sym[at < length[:, None]] = np.concatenate([words[w] for w in part])
            tree = np.full((n, 2 * size), NO_PAIR, dtype=np.int64)
            tree[:, size:] = ranks(sym[:, :size], sym[:, 1:size + 1])
            half = size
            while half > 1:
                tree[:, half // 2:half] = np.minimum(tree[:, half:2 * half:2], tree[:, half + 1:2 * half:2])
                half //= 2
            nxt = np.minimum(np.tile(at + 1, (n, 1)), length[:, None]).ravel()
            prv = np.tile(at - 1, (n, 1)).ravel()
            sym, tree, wide, deep = sym.ravel(), tree.ravel(), np.arange(n) * width, np.arange(n) * 2 * size

            def put(base: np.ndarray, leaf: np.ndarray, value: np.ndarray | int) -> None:
                i = leaf + size  # noqa: B023
                tree[base + i] = value  # noqa: B023
                for _ in range(size.bit_length() - 1):  # noqa: B023
                    low = np.minimum(tree[base + i], tree[base + (i ^ 1)])  # noqa: B023
                    i = i >> 1
                    tree[base + i] = low  # noqa: B023

            while len(live := np.flatnonzero(tree[deep + 1] != NO_PAIR)):
                base, row = deep[live], wide[live]
                low, i = tree[base + 1], np.ones(len(live), dtype=np.int64)
                for _ in range(size.bit_length() - 1):
                    i += i
                    i += tree[base + i] != low
                i -= size
                j = nxt[row + i]
                k, h, new = nxt[row + j], prv[row + i], made[low]
                sym[row + i], sym[row + j] = new, -1
                nxt[row + i], prv[row + k] = k, i
                inner = j < size
                put(base[inner], j[inner], NO_PAIR)
                put(base, i, ranks(new, np.where(k < length[live], sym[row + k], -1)))
                left = h >= 0
                put(base[left], h[left], ranks(sym[row[left] + h[left]], new[left]))
            rows = sym.reshape(n, width)
            kept = rows >= 0
            flat, cut = rows[kept].tolist(), np.append(0, kept.sum(axis=1).cumsum()).tolist()
            for k, w in enumerate(part):
                out[w] = flat[cut[k]:cut[k + 1]]
    return out


def packed(ids: list[int]) -> bytes:
    """Ids as 32-bit numbers: a tenth of a list's memory, and joined without a loop."""
    return array("i", ids).tobytes()


class Memo:
    """Results by word, in two generations: when the young one is full it becomes
    the old one, and what is asked for again moves to the young one."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, words: set[str]) -> list[str]:
        """Which of the words are new; the others are in the young generation afterwards."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = []
        for w in words.difference(young):
            if (found := old.get(w)) is None:
                new.append(w)
            else:
                young[w] = found
        return new


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level files."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        if b in kept:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def load(path: str) -> dict:
    """What encoding and decoding need of a word-level BPE file with word ends."""
    with open(path, "rb") as f:
        raw = f.read()
    spec = json.loads(raw)
    model = spec["model"]
    split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return {
        "name": hashlib.sha256(raw).hexdigest(),
        "vocab": model["vocab"],
        "merges": [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]],
        "suffix": model["end_of_word_suffix"] or "",
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
        "split": split,
    }


class Encoder:
    def __init__(self, spec: dict):
        self.split = regex.compile(spec["split"])
        self.special = regex.compile("|".join(map(regex.escape, sorted(spec["special"], key=len, reverse=True))))
        # a special token stands among the runs between blanks as its string after a blank
        self.special_runs = {" " + t: packed([i]) for t, i in spec["special"].items()}
        # symbols that aren't tokens get numbers past the vocabulary and leave no id
        number: dict[str, int] = dict(spec["vocab"])
        self.top = top = max(number.values()) + 1
        of = lambda s: number.setdefault(s, top + len(number))
        alphabet = byte_alphabet()
        self.inner, self.last = [of(c) for c in alphabet], [of(c + spec["suffix"]) for c in alphabet]
        self.ranks, self.made = {}, []
        for rank, (a, b) in enumerate(spec["merges"]):
            self.ranks[of(a) << 20 | of(b)] = rank
            self.made.append(of(a + b))
        pairs = np.array(list(self.ranks.items()), dtype=np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.table = (pairs[:, 0].copy(), pairs[:, 1].copy(), np.array(self.made, dtype=np.int64))
        self.words, self.runs = Memo(MEMO), Memo(MEMO)

    def symbols(self, word: str) -> list[int]:
        raw, inner = word.encode(), self.inner
        found = [inner[b] for b in raw]
        found[-1] = self.last[raw[-1]]
        return found

    def learn_words(self, words: set[str]) -> None:
        new = self.words.missing(words)
        short = [w for w in new if len(w) <= 32]
        young, top = self.words.young, self.top
        for w, ids in zip(short, merge_all([self.symbols(w) for w in short], *self.table)):
            young[w] = packed(ids if max(ids) < top else [i for i in ids if i < top])
        for w in new:
            if len(w) > 32:
                young[w] = packed([i for i in merge(self.symbols(w), self.ranks, self.made) if i < top])

    def learn(self, runs: set[str]) -> None:
        """Ids of runs between blanks."""
        new = self.runs.missing(runs)
        single, split = [], {}
        for r in new:
            if r.isalpha():
                single.append(r)
            elif r[-1] in ",." and r[:-1].isalpha():
                split[r] = (r[:-1], r[-1])
            else:
                split[r] = self.split.findall(r) if r[0] != " " else ()
        self.learn_words(set(single).union(*split.values()))
        words, young = self.words.young, self.runs.young
        for r in single:
            young[r] = words[r]
        for r, found in split.items():
            young[r] = b"".join([words[w] for w in found])
        young.update(self.special_runs)

    @staticmethod
    def plain(text: str) -> list[str]:
        """Runs between blanks of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # lower case goes character by character: a final sigma has no special form
        low = text.lower() if "\u03a3" not in text else "".join(c.lower() for c in text)
        if any(c in low for c in NOT_BLANK):
            return [p for p in BLANKS.split(low) if p]
        return low.split()

    def cut(self, text: str) -> list[str]:
        if "<|" not in text:
            return self.plain(text)
        out: list[str] = []
        at = 0
        for m in self.special.finditer(text):
            out += self.plain(text[at:m.start()])
            out.append(" " + m[0])
            at = m.end()
        return out + self.plain(text[at:])

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        flat, ends = self.encode_flat(texts)
        return [flat[a:b].tolist() for a, b in zip([0, *ends], ends)]

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
        """All ids, and where each text's end."""
        gc.disable()  # many small objects, none of them in a cycle
        try:
            cut = [self.cut(t) if t else [] for t in texts]
            self.learn(set().union(*cut))
            of = self.runs.young.__getitem__
            raw = [b"".join(map(of, runs)) for runs in cut]
        finally:
            gc.enable()
        return np.frombuffer(b"".join(raw), dtype=np.int32), list(itertools.accumulate(len(r) // 4 for r in raw))


def encoder(spec: dict) -> Encoder:
    """The worker's encoder of a vocabulary, kept from task to task."""
    if spec["name"] not in KEPT:
        KEPT.clear()
        KEPT[spec["name"]] = Encoder(spec)
    return KEPT[spec["name"]]


def _extend(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def _slices(batch: pa.RecordBatch, heavy: str, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``most`` bytes in the column ``heavy``."""
    size = pc.binary_length(batch.column(heavy)) if pa.types.is_string(batch.column(heavy).type) or pa.types.is_large_string(batch.column(heavy).type) else pc.list_value_length(batch.column(heavy))
    total = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b
    tidy()


def encode(df: DataFrame, vocab_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of every whole text in the array column ``out``
    (which replaces a column of that name)."""
    spec = df.sparkSession.sparkContext.broadcast(load(vocab_path))
    schema = _extend(df, out, T.ArrayType(T.IntegerType(), False))
    keep = [f.name for f in schema.fields if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        for whole in batches:
            for batch in _slices(whole, text, 1 << 20):
                flat, ends = enc.encode_flat(batch.column(text).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), ids], names=[*keep, out])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, vocab_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of the id list ``ids`` in ``out``: the file names no
    decoder, so the text is its tokens joined by single blanks, special tokens
    included; an id without a token is left out."""
    spec = df.sparkSession.sparkContext.broadcast(load(vocab_path))
    schema = _extend(df, out, T.StringType())
    keep = [f.name for f in schema.fields if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {i: t for t, i in [*spec.value["vocab"].items(), *spec.value["special"].items()]}
        top = max(names) + 1
        known = np.array([i in names for i in range(top)])
        token = pa.array([names.get(i, "") for i in range(top)], pa.string())
        for whole in batches:
            for batch in _slices(whole, ids, 1 << 20):
                lists = batch.column(ids)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(size)), size)
                if flat.dtype.kind == "f":  # there are null ids
                    flat = np.where(np.isnan(flat), -1, flat).astype(np.int64)
                ok = (flat >= 0) & (flat < top)
                ok[ok] = known[flat[ok]]
                flat, row = flat[ok], row[ok]
                offs = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(size)))]).astype(np.int32)
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array(offs), token.take(pa.array(flat, pa.int64()))), " ")
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), text], names=[*keep, out])

    return df.mapInArrow(run, schema)


def digest(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Length and digests of ids and decoded text, per document."""
    coded = decode(encode(df.select(id_col, text), vocab_path, text).drop(text), vocab_path)
    return coded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
