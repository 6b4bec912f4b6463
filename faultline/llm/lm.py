"""Language-model scores: a probabilistic suffix tree over characters and, below its
words, over words; beside it a unigram base score over words.

A text is read as its words, ASCII letters in lower case, one blank between
them and an end symbol.  The upper part of the tree has bytes as symbols: it grows by
one symbol a pass, from a candidate that makes up at least ``SUPPORT`` of all training
symbols (so a level has at most 1 / SUPPORT contexts, which workers hold).  A context is
retained if its next-symbol distribution diverges from that of its longest proper
suffix by ``DIVERGENCE`` nats or more; distributions are smoothed towards the suffix's.

The lower part has words as symbols and is as large as the corpus makes it: each word
that isn't one of the common ones is a context, and so is each such word with the word
before it, from the first occurrence on (``every``: common words are contexts as well).  They are smoothed towards the upper part's
probability of a word with the blank (or end) behind it, retained by the same test, and
never leave the tables of their bucket, which is that of the word.  A word is scored at
its longest retained context; where there is none, by its characters.

A training text's own occurrences don't speak for it: word contexts are counted without
the text that is scored (and without its identical rows), so a text that occurs once
is scored like one that was held out, and only what other texts hold raises it.

Base scores need the count of every word.  Counts come from a partial
aggregation over all training words.  Words that make up ``COMMON`` of them or
more (at most 1 / COMMON words) are broadcast; the rest travel once, packed,
to the bucket of their hash, where no word can be hot.  What follows a common word is
scored by its characters.

With ``every``, no word is left out: the words that occur more than ``HOT`` times take the place of
the common ones, and what follows them is dealt out by the word and the one before it. There the longer
context is whole; what the shorter one needs comes along: counts of its pairs with the word
behind from one more pass over the texts (only of those that several texts hold), and with each occurrence how often
its own text holds the word and the pair.

Defined results: a null text is empty and consists of its end; a null id counts
as fold 0; identical rows each train and each get the same scores; very long texts are
read whole; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import _text
from faultline.llm._cut import cut
from faultline.llm.quality import fold

DEPTH = 4
SUPPORT = 2e-5
DIVERGENCE = 0.005
WEIGHT = 16.0  # pseudo-count of the suffix's distribution
COMMON = 1e-5
BUCKET = 1 << 22  # tokens for each bucket of rare words
HOT = 1 << 20  # with ``every``: tokens for each bucket, and of a word from which it is dealt out to several
PACKED = 1 << 21  # bytes of text whose words go on together
SLICE = 1 << 20  # occurrences that are scored at once, of whole words
END, SYMBOLS = 256, 257
END_WORD = 0x5BD1E995  # hash that stands for the end token


def symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbol stream of a chunk and where each row's part ends; every row ends in END."""
    ink = ~_text.SPACE[data]
    kept = ink.copy()
    # a blank before a word stands for all between two words of a row
    kept[:-1] |= ink[1:]
    full = np.flatnonzero(np.diff(offs) > 0)
    tail = offs[full + 1] - 1
    kept[tail] = ink[tail]
    led = offs[full][~ink[offs[full]]]
    if len(led):
        at = np.flatnonzero(ink)
        head = at[np.minimum(np.searchsorted(at, led), len(at) - 1)] if len(at) else led
        kept[np.maximum(head - 1, 0)] &= ink[np.maximum(head - 1, 0)]
    low = _text.LOWER[data]
    low[~ink] = 32
    total = np.concatenate([[0], np.cumsum(kept)])[offs[1:]]
    return np.insert(low[kept].astype(np.int32), total, END), total + np.arange(1, len(offs))


def contexts(x: np.ndarray, steps: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each length 0, 1, ... the id of the context before each symbol; the id past the last stands for none."""
    before = np.concatenate([[END], x[:-1]]).astype(np.int32)
    here = np.zeros(len(x), dtype=np.int32)
    yield here
    for k, step in enumerate(steps):
        # what stands before a chunk's first symbol is the end of another text, which no longer context crosses
        last = np.concatenate([[0 if k == 0 else len(step) - 1], here[:-1]]).astype(np.int32)
        last *= SYMBOLS
        last += before
        here = step.ravel()[last]
        yield here


class Tree:
    """Candidates and counts by level; ``steps[k]`` leads from a context of length k
    and a symbol to one of length k + 1, and its last row from none to none."""

    def __init__(self) -> None:
        self.counts: list[np.ndarray] = []
        self.steps: list[np.ndarray] = []
        self.suffix: list[np.ndarray] = []

    def add(self, counts: np.ndarray) -> bool:
        """Counts of the next symbols at the deepest level; prepares the next level, False if it is empty."""
        self.counts.append(counts)
        least = SUPPORT * self.counts[0].sum()
        k = len(self.counts) - 1
        parent, symbol = np.nonzero(counts >= max(least, 1)) if k == 0 else np.nonzero((counts >= max(least, 1)) & (np.arange(SYMBOLS) != END))
        step = np.full((len(counts) + 1, SYMBOLS), len(parent), dtype=np.int32)
        step[parent, symbol] = np.arange(len(parent))
        if not len(parent):
            return False
        # dropping the oldest symbol of (context, symbol) is (suffix of context, symbol) one level up
        self.suffix.append(np.zeros(len(parent), dtype=np.int64) if k == 0 else self.steps[k - 1][self.suffix[k - 1][parent], symbol])
        self.steps.append(step)
        return True

    def finish(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """By level: the row of each context, and of none, in the table of log10 probabilities (-1: not retained), and that table."""
        root = self.counts[0][0]
        dist = [((root + 1.0) / (root.sum() + SYMBOLS))[None, :]]
        keep = [np.ones(1, dtype=bool)]
        for k in range(1, len(self.counts)):
            n, parent = self.counts[k], dist[k - 1][self.suffix[k - 1]]
            total = n.sum(axis=1, keepdims=True)
            p = (n + WEIGHT * parent) / (total + WEIGHT)
            keep.append((p * np.log(p / parent)).sum(axis=1) >= DIVERGENCE)
            dist.append(p)
        for k in range(len(keep) - 1, 1, -1):  # a retained context's suffixes are states as well
            keep[k - 1][self.suffix[k - 1][keep[k]]] = True
        out = []
        for d, r in zip(dist, keep):
            row = np.full(len(r) + 1, -1, dtype=np.int64)
            row[:-1][r] = np.arange(r.sum())
            out.append((row, np.log10(d[r]).astype(np.float32)))
        return out


def _sum_counts(docs: DataFrame, text: str, steps: list[np.ndarray], size: int) -> np.ndarray:
    """What follows each context of the deepest level, over all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(steps)
    cells = (size + 1) * SYMBOLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.int64)
        for batch in batches:
            for _, _, data, offs in _text.chunks(batch, text):
                x, _ = symbols(data, offs)
                *_, here = contexts(x, shared.value)
                at = here.astype(np.int64) * SYMBOLS + x
                if cells > 4 * len(at):
                    at, n = np.unique(at, return_counts=True)
                    total[at] += n
                else:
                    total += np.bincount(at, minlength=cells)
        key = np.flatnonzero(total[:size * SYMBOLS])
        for a in range(0, len(key), 1 << 16):
            part = key[a:a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["k", "n"])

    found = docs.select(text).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * SYMBOLS, dtype=np.int64)
    out[found.column("k").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(size, SYMBOLS)


def grow(train: DataFrame, text: str = "text", depth: int = DEPTH) -> Tree:
    """One pass for each length of context from 1 on (what follows no context is its
    sum); the driver holds the candidates' counts, bounded by SUPPORT."""
    tree = Tree()
    every = np.concatenate([np.arange(SYMBOLS, dtype=np.int32)[None, :], np.full((1, SYMBOLS), SYMBOLS, dtype=np.int32)])
    pairs = _sum_counts(train, text, [every], SYMBOLS)
    more = tree.add(pairs.sum(axis=0, keepdims=True))
    for k in range(1, depth + 1):
        if not more:
            break
        n = int(tree.steps[-1][-1, 0])  # none's id is their number
        counts = pairs[tree.steps[0][0] < n] if k == 1 else _sum_counts(train, text, list(tree.steps), n)
        more = tree.add(counts)
    return tree


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every token: words in lower case, then one end a row."""
    start, end, row = _text.words(data, offs)
    h = _text.span_hash(_text.prefix_hash(_text.LOWER[data]), start, end)
    n = len(offs) - 1
    return np.concatenate([h, np.full(n, END_WORD, np.uint64)]).view(np.int64), np.concatenate([row, np.arange(n)])


def word_counts(train: DataFrame, text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in _text.chunks(batch, text):
                h, n = np.unique(word_hashes(data, offs)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    return train.select(text).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _common(counts: DataFrame, every: bool = False) -> tuple[int, int, np.ndarray, np.ndarray]:
    """All tokens, all distinct tokens, and the common ones (``every``: the hot ones) with their counts."""
    row = counts.agg(F.sum("n"), F.count("*")).first()
    total, distinct = row[0] or 0, row[1]
    found = counts.where(F.col("n") >= (HOT + 1 if every else max(1, int(np.ceil(COMMON * total))))).toArrow()
    h, n = found.column("h").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(h)
    return total, distinct, h[order], n[order]


def _logs(x: np.ndarray, steps: list[np.ndarray], levels: list) -> np.ndarray:
    """log10 probability of each symbol at its longest retained context."""
    log = np.empty(len(x))
    left = np.arange(len(x))
    for here, (state, table) in reversed(list(zip(contexts(x, steps), levels))):
        at = state[here[left]]
        ok = at >= 0
        found = left[ok]
        log[found] = table.ravel()[at[ok] * SYMBOLS + x[found]]
        left = left[~ok]
    return log


def word_events(data: np.ndarray, offs: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every word, in order: its hash, its row, the word before it and the one behind
    it (32 bits of their hashes, 0 for none; a row's last word is another symbol), and the
    log10 probability of the one behind by its characters (NaN for none).  ``logs`` are those
    of all symbols."""
    start, end, row = _text.words(data, offs)
    h = _text.span_hash(_text.prefix_hash(_text.LOWER[data]), start, end)
    total = np.concatenate([[0.0], np.cumsum(logs)])
    # a word and what ends it are as many symbols as the word's bytes and one; a row without words is one
    size = end - start + 1
    empty = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(offs) - 1) == 0)])
    at = np.cumsum(size) - size + empty[row]
    own = total[at + size] - total[at]
    short = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    same = np.concatenate([row[1:] == row[:-1], [False]]) if len(row) else np.zeros(0, bool)
    last = short ^ (~same).astype(np.uint32) * np.uint32(0x5BD1E994)
    behind, before, log = np.zeros(len(h), np.uint32), np.zeros(len(h), np.uint32), np.full(len(h), np.nan, np.float32)
    if len(h):
        behind[:-1], before[1:] = np.where(same[:-1], last[1:], 0), np.where(same[:-1], short[:-1], 0)
        log[:-1] = np.where(same[:-1], own[1:], np.nan)
    return h, row, before.view(np.int32), behind.view(np.int32), log


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of each row's pair of numbers, from 0 on."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def _level(context: np.ndarray, symbol: np.ndarray, key: np.ndarray, train: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability, retained) for each occurrence of a symbol behind a context.  ``below``
    is the symbol's probability in the suffix; the test takes all training rows, the
    probability those of other texts."""
    pair = _joined(context, symbol)
    first = np.zeros(int(pair.max(initial=-1)) + 1, dtype=np.int64)
    first[pair] = np.arange(len(pair))  # a row of each pair
    whole = lambda code: np.bincount(code, weights=train)[code]
    n, n_pair = whole(context), whole(pair)
    own, own_pair = whole(_joined(context, key)), whole(_joined(pair, key))
    p = (n_pair - own_pair + WEIGHT * below) / (n - own + WEIGHT)
    # divergence from the suffix, with a symbol's mean probability there; what wasn't seen goes together
    mean = (np.bincount(pair, weights=below) / np.bincount(pair))
    total, seen = n[first], n_pair[first] > 0
    q = (n_pair[first] + WEIGHT * mean) / (total + WEIGHT)
    group = context[first]
    apart = np.bincount(group, weights=np.where(seen, q * np.log(q / mean), 0))
    left = WEIGHT / (np.bincount(group, weights=total) / np.maximum(np.bincount(group), 1) + WEIGHT)
    apart += np.maximum(1 - np.bincount(group, weights=np.where(seen, mean, 0)), 0) * left * np.log(left)
    return p, (apart >= DIVERGENCE)[context] & (n > 0)


def word_gains(word: np.ndarray, before: np.ndarray, behind: np.ndarray, log: np.ndarray, key: np.ndarray, train: np.ndarray) -> np.ndarray:
    """What word contexts add to the log10 probability of the word behind each occurrence
    of the words (by number, as ``key`` is), of which all in the corpus are given that can add any."""
    if not len(log):
        return np.zeros(0)
    number = lambda x: np.unique(x, return_inverse=True)[1]
    behind, train = number(behind), train.astype(np.float64)
    base = np.maximum(10.0 ** log.astype(np.float64), 1e-300)
    p1, keep1 = _level(word, behind, key, train, base)
    p2, keep2 = _level(_joined(word, number(before)), behind, key, train, p1)
    return np.log10(np.where(keep2, p2, np.where(keep1, p1, base)) / base)


def _by_slices(word: np.ndarray, *values: np.ndarray) -> np.ndarray:
    """``word_gains`` of whole words at a time, about SLICE occurrences."""
    out = np.zeros(len(word))
    order = np.argsort(word, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(word[order]) > 0])) if len(word) else np.zeros(0, np.int64)
    starts = first[np.flatnonzero(np.concatenate([[True], np.diff(first // SLICE) > 0]))] if len(first) else first
    for a, b in zip(starts, np.append(starts[1:], len(word))):
        part = order[a:b]
        out[part] = word_gains(word[part], *(v[part] for v in values))
    return out


def _hot_events(hot: np.ndarray, sub: np.ndarray, h: np.ndarray, row: np.ndarray, before: np.ndarray, behind: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each occurrence of a hot word that a word follows: its position, the word's number in ``hot``, which of the word's
    ``sub`` buckets it goes to, and how often its row holds the word there, the word, and the pair with what follows."""
    at = np.minimum(np.searchsorted(hot, h), max(len(hot) - 1, 0))
    here = np.flatnonzero((hot[at] == h) & ~np.isnan(log)) if len(hot) else np.zeros(0, np.int64)
    w, row = at[here], row[here]
    to = (_text.mix(before[here].view(np.uint32).astype(np.uint64) + np.uint64(1)) % sub[w].astype(np.uint64)).astype(np.int64)
    times = lambda code: np.bincount(code)[code] if len(code) else code
    own = _joined(w, row)
    return here, w, to, times(_joined(own, to)), times(own), times(_joined(own, np.unique(behind[here], return_inverse=True)[1]))


def _pairs(docs: DataFrame, hot: np.ndarray, tree: Tree, levels: list) -> DataFrame:
    """(w, behind, n, c, s, lo, hi): pairs of a hot word and the one behind it, how often training texts and all texts hold
    them, the sum of their probabilities by characters, and the least and largest key of a text that holds them."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, tree.steps[:len(levels) - 1], levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, steps, levels = shared.value
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            train = batch.column("train").to_numpy(zero_copy_only=False)
            for a, b, data, offs in _text.chunks(batch, "text"):
                h, row, before, behind, log = word_events(data, offs, _logs(symbols(data, offs)[0], steps, levels))
                here, w, *_ = _hot_events(hot, np.ones(len(hot), np.int64), h.view(np.int64), row, before, behind, log)
                if len(here):
                    behind, base, of, ok = behind[here], 10.0 ** log[here].astype(np.float64), key[a:b][row[here]], train[a:b][row[here]]
                    order = np.lexsort((behind, w))
                    w, behind, base, of, ok = (v[order] for v in (w, behind, base, of, ok))
                    first = np.flatnonzero(np.concatenate([[True], (np.diff(w) != 0) | (np.diff(behind) != 0)]))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(w[first].astype(np.int32)), pa.array(behind[first]), pa.array(np.add.reduceat(ok.astype(np.int64), first)), pa.array(np.diff(np.append(first, len(w)))),
                        pa.array(np.add.reduceat(np.maximum(base, 1e-300), first)), pa.array(np.minimum.reduceat(of, first)), pa.array(np.maximum.reduceat(of, first)),
                    ], names=["w", "behind", "n", "c", "s", "lo", "hi"])

    found = docs.select("key", "text", "train").mapInArrow(run, "w int, behind int, n long, c long, s double, lo long, hi long")
    return cut(found.groupBy("w", "behind").agg(*(f(c).alias(c) for f, c in ((F.sum, "n"), (F.sum, "c"), (F.sum, "s"), (F.min, "lo"), (F.max, "hi")))), "pairs")


def _retained(pairs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each hot word how often a word follows it in training texts, and whether it is retained (the test of ``_level``)."""
    total = pairs.groupBy("w").agg(F.sum("n").alias("total"))
    mean = F.col("s") / F.col("c")
    q = (F.col("n") + WEIGHT * mean) / (F.col("total") + WEIGHT)
    seen = pairs.where("n > 0").join(F.broadcast(total), "w").groupBy("w", "total").agg(F.sum(q * F.log(q / mean)).alias("apart"), F.sum(mean).alias("mean")).toArrow()
    w, n, apart, mean = (seen.column(c).to_numpy() for c in ("w", "total", "apart", "mean"))
    left = WEIGHT / (n + WEIGHT)
    count, keep = np.zeros(size), np.zeros(size, bool)
    count[w], keep[w] = n, apart + np.maximum(1 - mean, 0) * left * np.log(left) >= DIVERGENCE
    return count, keep


def hot_gains(
    w: np.ndarray, before: np.ndarray, behind: np.ndarray, log: np.ndarray, key: np.ndarray, train: np.ndarray, own: np.ndarray, pair: np.ndarray, held: np.ndarray,
    of: tuple[np.ndarray, np.ndarray], hot: tuple[np.ndarray, np.ndarray],
) -> np.ndarray:
    """``word_gains`` of hot words' occurrences, of which all with a word before them are given.

    ``own`` and ``pair``: how often one row of the text holds the word and the pair, of which ``held`` are in this bucket; ``of``: pairs
    (word and the one behind it, ordered) that several texts hold, and their counts; ``hot``: counts and retention by word."""
    train = train.astype(np.float64)
    rows = lambda code: np.bincount(code)[code]
    same = rows(_joined(w, key)) / held  # identical rows
    code = (w.astype(np.int64) << 32) | behind.view(np.uint32)
    at = np.minimum(np.searchsorted(of[0], code), max(len(of[0]) - 1, 0))
    known = of[0][at] == code if len(of[0]) else np.zeros(len(code), bool)
    # a pair of one text has no other text to speak for it
    others = np.where(known, of[1][at] - train * same * pair, 0) if len(of[0]) else np.zeros(len(code))
    base = np.maximum(10.0 ** log.astype(np.float64), 1e-300)
    p1 = (others + WEIGHT * base) / (hot[0][w] - train * same * own + WEIGHT)
    number = lambda x: np.unique(x, return_inverse=True)[1]
    p2, keep2 = _level(_joined(number(w), number(before)), number(behind), key, train, p1)
    return np.log10(np.where(keep2, p2, np.where(hot[1][w], p1, base)) / base)


SENT = (
    # rare words: their hashes and in how many rows each is, the rows' keys, then by word and row the row and how often, then all occurrences
    "bucket int, h array<long>, rows array<int>, key array<long>, train array<boolean>, row array<short>, n array<int>, before array<int>, behind array<int>, log array<float>, "
    "row_key array<long>, row_n array<long>, row_s array<double>, row_k array<long>, row_score array<double>, "  # rows of texts
    "hot_w array<int>, hot_key array<long>, hot_train array<boolean>, hot_before array<int>, hot_behind array<int>, hot_log array<float>, hot_held array<int>, hot_own array<int>, hot_pair array<int>, "
    "pair_w array<int>, pair_behind array<int>, pair_n array<long>"  # hot words, and their pairs
)
SUMS = (("n", pa.int64()), ("s", pa.float64()), ("k", pa.int64()), ("g", pa.float64()), ("score", pa.float64()), ("m", pa.int64()))


def _dealt(key: np.ndarray, buckets: int, *values: np.ndarray) -> pa.RecordBatch:
    """Sums by key as one row for each bucket of keys."""
    to = (_text.mix(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(to, kind="stable")
    to = to[order]
    cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    ends = pa.array(np.append(cut, len(to)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(v[order], t)) for v, t in zip((key, *values), (pa.int64(), *(t for _, t in SUMS)))]
    return pa.RecordBatch.from_arrays([pa.array(to[cut]), *lists], names=["to", "key", *(c for c, _ in SUMS)])


def _sums(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], buckets: int, tree: Tree, every: bool = False) -> DataFrame:
    """For each key the sums over its rows (``m`` of them) of: tokens, log10(c + 1) over known
    tokens, known tokens, what word contexts add to the score, and the score by characters.

    ``docs``: key, text, train.  Common words are looked up where the text is read.  The rare words of a
    bucket are all there is of them, so counts need no join; with ``every`` the occurrences of common (then: hot) words go to
    the buckets of the word and the one before it, together with the counts that they need.  A bucket's sums go on packed by key, so what
    moves doesn't grow with the number of buckets."""
    levels = tree.finish()
    shared = docs.sparkSession.sparkContext.broadcast((*common, tree.steps[:len(levels) - 1], levels))
    names = [c.split()[0] for c in SENT.split(", ")]
    value_of = {"long": pa.int64(), "int": pa.int32(), "short": pa.int16(), "boolean": pa.bool_(), "float": pa.float32(), "double": pa.float64()}
    kinds = [pa.list_(value_of[c.split("<")[1].rstrip(">")]) for c in SENT.split(", ")[1:]]
    rare, whole, often, paired = slice(0, 9), slice(9, 14), slice(14, 23), slice(23, 26)
    sub = np.minimum(-(-np.asarray(common[1], np.int64) // HOT), buckets)  # buckets of a hot word
    some = every and len(common[0]) > 0
    pairs = _pairs(docs, common[0], tree, levels) if some else None
    hot = _retained(pairs, len(common[0])) if some else None

    def bucket_of(h: np.ndarray, to: np.ndarray) -> np.ndarray:
        return ((_text.mix(h.view(np.uint64)) % np.uint64(buckets)).astype(np.int64) + to) % buckets

    def record(bucket: np.ndarray, part: slice, lists: list[pa.Array]) -> pa.RecordBatch:
        none = [pa.nulls(len(bucket), t) for t in kinds]
        none[part] = lists
        return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *none], names=names)

    def grouped(bucket: np.ndarray, part: slice, values: list[np.ndarray]) -> pa.RecordBatch:
        """One row a bucket."""
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = pa.array(np.append(first, len(bucket)).astype(np.int32))
        return record(bucket[first], part, [pa.ListArray.from_arrays(ends, pa.array(v[order], t.value_type)) for v, t in zip(values, kinds[part])])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, steps, levels = shared.value
        value = np.log10(counts + 1.0)
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            train = batch.column("train").to_numpy(zero_copy_only=False)
            for a, b, data, offs in _text.chunks(batch, "text", PACKED, (1 << 15) - 1):
                n, ends = b - a, np.int64(END_WORD)
                x, stop = symbols(data, offs)
                logs = _logs(x, steps, levels)
                h, row, before, behind, log = word_events(data, offs, logs)
                # an end follows no word, and nothing follows it
                h, row = np.concatenate([h.view(np.int64), np.full(n, ends)]), np.concatenate([row, np.arange(n)])
                none = np.zeros(n, np.int32)
                before, behind, log = np.concatenate([before, none]), np.concatenate([behind, none]), np.concatenate([log, np.full(n, np.nan, np.float32)])
                at = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
                hit = words[at] == h if len(words) else np.zeros(len(h), dtype=bool)
                own = (
                    key[a:b], np.bincount(row, minlength=n), np.bincount(row[hit], weights=value[at[hit]] if len(words) else None, minlength=n).astype(np.float64),
                    np.bincount(row[hit], minlength=n), np.add.reduceat(logs, np.append(0, stop[:-1])),
                )
                one = pa.array([0, n], pa.int32())
                yield record(np.array([int(key[a]) % buckets]), whole, [pa.ListArray.from_arrays(one, pa.array(v, t.value_type)) for v, t in zip(own, kinds[whole])])
                if every:
                    here, w, to, held, times, pair = _hot_events(words, sub, h, row, before, behind, log)
                    if len(here):
                        of = row[here]
                        yield grouped(bucket_of(words[w], to), often, [w, key[a:b][of], train[a:b][of], before[here], behind[here], log[here], held, times, pair])
                h, row, before, behind, log = (v[~hit] for v in (h, row, before, behind, log))
                pair = np.lexsort((row, h, h.view(np.uint64) % np.uint64(buckets)))
                h, row, before, behind, log = (v[pair] for v in (h, row, before, behind, log))
                if not len(h):
                    continue
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]))
                times = np.diff(np.append(first, len(h))).astype(np.int32)
                bucket = (h.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
                each = pa.array(np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(h)).astype(np.int32))
                h, row, bucket = h[first], row[first], bucket[first]
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                to = np.append(cut, len(h))
                new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                names_to, number = np.searchsorted(new, to), np.repeat(np.arange(len(cut)), np.diff(to))
                here, at = np.unique(number * n + row, return_inverse=True)
                keys_to = np.searchsorted(here, np.arange(len(cut) + 1) * n)
                texts = slice(a, b)
                lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v, t.value_type)) for ends, v, t in zip(
                    (names_to, names_to, keys_to, keys_to, to, to),
                    (h[new], np.diff(np.append(new, len(h))), key[texts][here % n], train[texts][here % n], at - keys_to[number], times), kinds[rare],
                )]
                lists += [pa.ListArray.from_arrays(each, pa.array(v)) for v in (before, behind, log)]
                yield record(bucket[cut], rare, lists)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs, once for each bucket of their hot word."""
        words = shared.value[0]
        for batch in batches:
            w, behind, n = (batch.column(c).to_numpy() for c in ("w", "behind", "n"))
            each = np.repeat(np.arange(len(w)), sub[w])
            if len(each):
                to = np.arange(len(each)) - np.repeat(np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]])), sub[w])
                yield grouped(bucket_of(words[w[each]], to), paired, [w[each], behind[each], n[each]])

    def spelled(b: pa.RecordBatch, flat: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """h, key, n, train by word and row, and the occurrences."""
        h, rows, key, ok, row, n, *events = flat
        size = lambda c: pc.fill_null(pc.list_value_length(b.column(c)), 0).to_numpy()
        keys = size("key")
        at = row + np.repeat(np.cumsum(keys) - keys, size("row"))
        return np.repeat(h, rows), key[at], n, ok[at], *events

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, hots, known = [], [], []
        for b in batches:
            if b.num_rows:
                flat = [b.column(c).flatten().to_numpy(zero_copy_only=False) for c in names[1:]]
                parts.append(spelled(b, flat[rare]))
                for to, part in ((hots, often), (known, paired)):
                    if len(flat[part][0]):
                        to.append(flat[part])
                own = flat[whole]
                if len(own[0]):
                    yield _dealt(own[0], buckets, own[1], own[2], own[3], np.zeros(len(own[0])), own[4], np.ones(len(own[0]), np.int64))
        h, key, n, train, before, behind, log = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0)] * 7
        if len(h):
            _, word = np.unique(h, return_inverse=True)
            c = np.bincount(word, weights=n * train)[word]
            keys, at = np.unique(key, return_inverse=True)
            s, k = np.bincount(at, weights=n * np.log10(c + 1)), np.bincount(at, weights=n * (c > 0)).astype(np.int64)
            # a word of one text has no other text to speak for it
            held = np.repeat(np.bincount(word)[word] > 1, n) & ~np.isnan(log)
            of = np.repeat(at, n)[held]
            gain = _by_slices(np.repeat(word, n)[held], before[held], behind[held], log[held], of, np.repeat(train, n)[held])
            g = np.bincount(of, weights=gain, minlength=len(keys)).astype(np.float64)
            none = np.zeros(len(keys), np.int64)
            yield _dealt(keys, buckets, none, s, k, g, none.astype(np.float64), none)
        del parts, h, key, n, train, before, behind, log
        if hots:
            w, *values = (np.concatenate(x) for x in zip(*hots))
            hots.clear()
            pw, pb, pn = (np.concatenate(x) for x in zip(*known)) if known else (np.zeros(0, t) for t in (np.int32, np.int32, np.int64))
            code = (pw.astype(np.int64) << 32) | pb.view(np.uint32)
            order = np.argsort(code)
            code, pn = code[order], pn[order]
            order = np.argsort(w, kind="stable")
            ends = np.flatnonzero(np.concatenate([np.diff(w[order]) > 0, [True]])) + 1
            for a, b in zip(np.append(0, ends[:-1]), ends):  # a word at a time
                part = order[a:b]
                key, train, before, behind, log, held, times, pair = (v[part] for v in values)
                keys, at = np.unique(key, return_inverse=True)
                g = np.bincount(at, weights=hot_gains(w[part], before, behind, log, at, train, times, pair, held, (code, pn), hot))
                none = np.zeros(len(keys), np.int64)
                yield _dealt(keys, buckets, none, none.astype(np.float64), none, g, none.astype(np.float64), none)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["key", *(c for c, _ in SUMS)]
        parts = [tuple(b.column(c).flatten().to_numpy(zero_copy_only=False) for c in columns) for b in batches if b.num_rows]
        if parts:
            key, *values = (np.concatenate(x) for x in zip(*parts))
            keys, at = np.unique(key, return_inverse=True)
            sums = [np.bincount(at, weights=v) for v in values]
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(v.astype(t.to_pandas_dtype())) for v, (_, t) in zip(sums, SUMS))], names=columns)

    kind = {pa.int64(): "long", pa.float64(): "double"}
    listed = ", ".join(f"{c} array<{kind[t]}>" for c, t in SUMS)
    sent = docs.select("key", "text", "train").mapInArrow(pack, SENT)
    if some:
        sent = sent.unionByName(pairs.where("lo < hi").select("w", "behind", "n").mapInArrow(counted, SENT))
    by_word = sent.repartitionById(buckets, "bucket")
    by_key = by_word.mapInArrow(add, f"to int, key array<long>, {listed}").repartitionById(buckets, "to")
    return by_key.mapInArrow(total, "key long, " + ", ".join(f"{c} {kind[t]}" for c, t in SUMS))


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2, every: bool = False) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, learnt from the rows outside fold ``held``.

    ``every``: all words are contexts, the common ones too."""
    spark = docs.sparkSession
    out = F.coalesce(fold(id_col, folds), F.lit(0)) == held
    rows = docs.select(F.col(id_col), F.col(text).alias("text"), out.alias("held_out"), (~out).alias("train"), F.xxhash64(F.col(id_col), F.col(text)).alias("key"))
    train = rows.where("train")
    total, distinct, words, counts = _common(cut(word_counts(train), "words"), every)
    tree = grow(train)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // (HOT if every else BUCKET)))
    # identical rows share a key and have equal parts, so means over the m rows are each one's values
    summed = _sums(rows, (words, counts), buckets, tree, every)
    norm = float(np.log10(total + distinct + 1))
    mean = lambda c: F.col(c) / F.col("m")
    return rows.select(id_col, "held_out", "key").join(summed, "key").select(
        id_col, "held_out", F.round(mean("n")).cast("long").alias("n_tokens"), F.round(mean("k")).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (mean("s") - F.round(mean("n")) * norm).alias("base_score"),
        (mean("score") + mean("g")).alias("score"),
    )
