"""Source divergence audit by chunk factorization.

Texts are cut at white space; a chunk of text between blanks holds every term
that touches it whole, so terms need to be found once for each distinct chunk of
the corpus.  A block of documents keeps, for each document, which chunks of the
block's list it has and how often; lists are united over the corpus, each
distinct chunk is tokenized once, and its terms come back to the blocks and to
their place (without terms too rare to be kept, which a filter of fixed size tells).
Lists travel in parts, one for each bucket of chunks, so what moves is a string a chunk
and not a row.  There they give, per (lang, term), the documents that hold the term and its
occurrences by source, summed over blocks.

Counts of a source in one language against each other source of it are compared
in tiles of sources and terms, so a language with many terms or sources is many
tasks, and what leaves a tile is one number for a pair of sources.

Defined results: a null text, lang or source counts as ''; every row is a
document, repeated ones too; a group without terms gets the value of an empty
count for every kept term; very long texts and chunks are taken whole; an empty
table gives an empty result.  Other columns, of any name, are not read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm import _filter, _text
from faultline.llm._cut import ROWS, cut

# Fixed values of the contract: a term's characters, the smoothing, the scale of shares.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
PRIOR, SCALE = 5, 1_000_000_000
MIN_DOCS = 30
TOP = 50

BLOCK = 1 << 24  # bytes of text that share one list of distinct chunks
DENSE = 1 << 24  # cells of a table of counts in a worker
TILE_TERMS, TILE_SOURCES = 4096, 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BLOCKS = (
    "block long, lang string, source long, steps binary, times binary, wide_steps array<int>, wide_times array<int>, "  # a document
    "bucket int, first int, chunks array<string>, counts array<long>"  # a part of a block's list
)
TOKENIZED = (
    "block long, first int, sizes array<int>, terms array<string>, "  # a part of a block's list
    "total_keys array<long>, totals array<long>"  # how often terms occur in a bucket
)
SUMS = "lang string, term string, docs long, sources array<long>, counts array<int>"


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of documents of about BLOCK bytes, across batches."""
    held, size = [], 0
    for batch in batches:
        offs = _text.column(batch, "text")[1]
        a = 0
        while a < batch.num_rows:
            b = min(batch.num_rows, max(a + 1, int(np.searchsorted(offs, offs[a] + BLOCK - size, "right")) - 1))
            held.append(batch.slice(a, b - a))
            size += int(offs[b] - offs[a])
            a = b
            if size >= BLOCK or a < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _keys(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct strings; they deal out work and filter, nothing is decided by them."""
    return hash_array(strings.to_numpy(zero_copy_only=False).astype(object), categorize=False).view(np.int64)


def _narrow(x: np.ndarray, ends: np.ndarray, kind: type) -> tuple[pa.Array, pa.Array]:
    """Lists of numbers as bytes of a small type, and the numbers that don't fit it."""
    top = np.iinfo(kind).max
    wide = x >= top
    raw = np.where(wide, top, x).astype(kind)
    offs = (ends * raw.itemsize).astype(np.int32)
    own = np.concatenate([[0], np.cumsum(wide)])[ends].astype(np.int32)
    return (
        pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(raw.tobytes())]),
        pa.ListArray.from_arrays(pa.array(own), pa.array(x[wide].astype(np.int32))),
    )


def _widened(small: pa.Array, wide: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, offsets) of what ``_narrow`` made."""
    if not len(small):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    offs = np.frombuffer(small.buffers()[1], dtype=np.int32)[small.offset:small.offset + len(small) + 1].astype(np.int64)
    raw = small.buffers()[2]
    out = np.frombuffer(raw, dtype=np.uint8)[offs[0]:offs[-1]].view(kind).astype(np.int64) if offs[-1] > offs[0] else np.zeros(0, np.int64)
    out[out == np.iinfo(kind).max] = wide.flatten().to_numpy()
    return out, (offs - offs[0]) // np.dtype(kind).itemsize


def _chunk_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """One row per document: its chunks by place in the block's list (in order, as steps
    from one to the next) and their number; and for each bucket of a block's list: its
    distinct chunks, which take consecutive places, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        ints, longs, strings, raw = pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary()
        for part in _blocks_of(batches):
            n = part.num_rows
            split = pc.ascii_split_whitespace(part.column("text").combine_chunks().cast(pa.large_string()))
            coded = split.flatten().dictionary_encode()
            row = np.repeat(np.arange(n), pc.list_value_length(split).to_numpy(zero_copy_only=False))
            listed, size = coded.dictionary, max(len(coded.dictionary), 1)
            bucket = (_keys(listed) & (1 << 40) - 1) % buckets
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            found = place[coded.indices.to_numpy(zero_copy_only=False)]
            own, times = np.unique(row * size + found, return_counts=True)
            ends, at = np.searchsorted(own // size, np.arange(n + 1)), own % size
            steps = np.diff(at, prepend=0)
            first = ends[:-1][ends[1:] > ends[:-1]]
            steps[first] = at[first]
            (steps, wide_steps), (times, wide_times) = _narrow(steps, ends, np.uint16), _narrow(times, ends, np.uint8)
            lists = (steps, times, wide_steps, wide_times)
            for k in range(0, n, ROWS):
                m = min(ROWS, n - k)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(m, number)), *(part.column(c).combine_chunks().slice(k, m) for c in ("lang", "source")), *(x.slice(k, m) for x in lists),
                    *(pa.nulls(m, t) for t in (pa.int32(), pa.int32(), strings, longs)),
                ], names=names)
            kept, start = np.unique(bucket[order], return_index=True)
            m, ends = len(kept), pa.array(np.append(start, len(order)).astype(np.int32))
            chunks, counts = listed.take(pa.array(order)).cast(pa.string()), pa.array(np.bincount(found, minlength=len(order)))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(m, number)), *(pa.nulls(m, t) for t in (pa.string(), pa.int64(), raw, raw, ints, ints)), pa.array(kept.astype(np.int32)), pa.array(start.astype(np.int32)),
                pa.ListArray.from_arrays(ends, chunks), pa.ListArray.from_arrays(ends, counts),
            ], names=names)
            number += 1
            _text.tidy()

    return docs.mapInArrow(run, BLOCKS)


def _tokenized(lists: DataFrame, buckets: int) -> DataFrame:
    """The terms of all chunks of a bucket, each distinct chunk read once: for every part of
    a block's list the terms of its chunks in order, and for the bucket how often its
    terms occur.  A task remembers the distinct chunks of its bucket, whose share of the
    corpus' vocabulary the number of buckets sets."""
    find, change = re.compile(TERM).findall, str.maketrans(UPPER, LOWER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in TOKENIZED.split(", ")]
        ints, longs, strings = pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())
        known: dict[str, tuple[int, ...]] = {}  # a chunk's terms by number
        number: dict[str, int] = {}
        totals = np.zeros(1 << 10, dtype=np.int64)
        for batch in batches:
            chunks, counts = (batch.column(c) for c in ("chunks", "counts"))
            lengths, coded = np.diff(chunks.offsets.to_numpy()), chunks.flatten().dictionary_encode()
            flat = coded.dictionary.to_pylist()
            for c in set(flat).difference(known):
                known[c] = tuple(number.setdefault(t, len(number)) for t in find(c.translate(change)))
            found = list(map(known.__getitem__, flat))
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            at = np.fromiter(itertools.chain.from_iterable(found), dtype=np.int64, count=int(sizes.sum()))
            # from the distinct chunks to all
            chunk = coded.indices.to_numpy(zero_copy_only=False)
            first, sizes = (np.cumsum(sizes) - sizes)[chunk], sizes[chunk]
            at = at[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            if len(number) > len(totals):
                totals = np.concatenate([totals, np.zeros(max(len(totals), len(number) - len(totals)), dtype=np.int64)])
            np.add.at(totals, at, np.repeat(counts.flatten().to_numpy(), sizes))
            listed = pa.array(list(number), pa.string())
            there = np.zeros(len(number), dtype=bool)
            there[at] = True
            back, own = (np.cumsum(there) - 1)[at], listed.filter(pa.array(there))
            starts = np.concatenate([[0], np.cumsum(lengths)])
            ends = np.concatenate([[0], np.cumsum(sizes)])[starts]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column("block"), batch.column("first"), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(sizes.astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), own.take(pa.array(back))), pa.nulls(n, longs), pa.nulls(n, longs),
            ], names=names)
        if number:
            one = pa.array([0, len(number)], pa.int32())
            yield pa.RecordBatch.from_arrays([
                *(pa.nulls(1, t) for t in (pa.int64(), pa.int32(), ints, strings)),
                pa.ListArray.from_arrays(one, pa.array(_keys(pa.array(list(number), pa.string())))), pa.ListArray.from_arrays(one, pa.array(totals[:len(number)])),
            ], names=names)

    return lists.repartitionById(buckets, "bucket").select("block", "first", "chunks", "counts").mapInArrow(run, TOKENIZED)


def _common_enough(parts: DataFrame, bits, min_docs: int) -> DataFrame:
    """``block, pos, sizes, terms`` of the chunks with terms that may be kept, the others
    left out: ``bits`` hold the terms that occur ``min_docs`` times or more, since no other
    can stand in as many documents.  Some rare terms pass a filter of fixed size; the
    count of documents drops them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, own = (batch.column(c) for c in ("sizes", "terms"))
            per_row, size = np.diff(sizes.offsets.to_numpy()), sizes.flatten().to_numpy()
            coded = own.flatten().dictionary_encode()
            common = np.ones(len(coded.dictionary), dtype=bool) if min_docs <= 1 else _filter.holds(bits.value, _keys(coded.dictionary))
            held = common[coded.indices.to_numpy(zero_copy_only=False)]
            chunk = np.repeat(np.arange(len(size)), size)
            left = np.bincount(chunk[held], minlength=len(size))
            row = np.repeat(np.arange(batch.num_rows), per_row)
            pos = np.arange(len(size)) - np.repeat(np.cumsum(per_row) - per_row, per_row) + batch.column("first").to_numpy()[row]
            some = left > 0
            per = np.bincount(row[some], minlength=batch.num_rows)
            cut_at = pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32))
            terms_at = np.concatenate([[0], np.cumsum(left)])[np.concatenate([[0], np.cumsum(per_row)])].astype(np.int32)
            out = pa.RecordBatch.from_arrays([
                batch.column("block"), pa.ListArray.from_arrays(cut_at, pa.array(pos[some].astype(np.int32))),
                pa.ListArray.from_arrays(cut_at, pa.array(left[some].astype(np.int32))), pa.ListArray.from_arrays(pa.array(terms_at), own.flatten().filter(pa.array(held))),
            ], names=["held_by", "pos", "sizes", "terms"])
            yield out.filter(pa.array(per > 0))

    return parts.mapInArrow(run, "held_by long, pos array<int>, sizes array<int>, terms array<string>")


def _codes(a: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    coded = a.combine_chunks().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _summed(key: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys below ``size`` and their sums, counted in a table where that is small."""
    if size <= DENSE:
        total = np.bincount(key, weights=n, minlength=0)
        found = np.flatnonzero(total)
        return found, total[found].astype(np.int64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1) > 0)
    return key[first], np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)


def _sum_block(left: pa.Table, right: pa.Table) -> pa.Table:
    """Each (lang, term) of a block: documents that hold it, and occurrences by source.
    ``left`` are the documents, ``right`` the terms of their chunks."""
    pos, per_chunk = (right.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("pos", "sizes"))
    coded = right.column("terms").combine_chunks().flatten().dictionary_encode()
    term, n_terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(coded.dictionary), 1)
    steps, times, wide_steps, wide_times = (left.column(c).combine_chunks() for c in ("steps", "times", "wide_steps", "wide_times"))
    (steps, ends), (times, _) = _widened(steps, wide_steps, np.uint16), _widened(times, wide_times, np.uint8)
    lengths = np.diff(ends)
    doc, at = np.repeat(np.arange(left.num_rows), lengths), np.cumsum(steps)
    at -= np.repeat(np.concatenate([[0], at])[np.cumsum(lengths) - lengths], lengths)
    # where the terms of the chunk at each place of the block's list begin, and how many they are
    most = max(int(pos.max(initial=-1)), int(at.max(initial=-1))) + 1
    first, size = np.zeros(most, dtype=np.int64), np.zeros(most, dtype=np.int64)
    first[pos], size[pos] = np.cumsum(per_chunk) - per_chunk, per_chunk

    n = size[at]
    here = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    term, doc, times = term[here], np.repeat(doc, n), np.repeat(times, n)
    (lang, langs), (source, sources) = _codes(left.column("lang")), _codes(left.column("source"))
    n_source = max(len(sources), 1)
    entry, count = _summed((lang[doc] * n_terms + term) * n_source + source[doc], times, max(len(langs), 1) * n_terms * n_source)
    key, start = np.unique(entry // n_source, return_index=True)
    held = np.sort(doc * n_terms + term)
    held = held[np.diff(held, prepend=-1) > 0]
    docs = np.bincount(np.searchsorted(key, lang[held // n_terms] * n_terms + held % n_terms), minlength=len(key))
    ends = pa.array(np.append(start, len(entry)).astype(np.int32))
    return pa.table({
        "lang": langs.take(pa.array(key // n_terms)), "term": coded.dictionary.take(pa.array(key % n_terms)), "docs": docs,
        "sources": pa.ListArray.from_arrays(ends, sources.take(pa.array(entry % n_source))), "counts": pa.ListArray.from_arrays(ends, pa.array(count.astype(np.int32))),
    })


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _numbered_groups(df: DataFrame, lang: str, source: str) -> tuple[DataFrame, Column]:
    """(lang, source, number) of all groups, and the expression of a row's number: a hash
    with a seed for which no two groups of a language share one."""
    groups = cut(df.select(_filled(lang).alias("lang"), _filled(source).alias("source")).distinct(), "groups")
    for seed in itertools.count():
        number = lambda c: F.xxhash64(F.lit(seed), c)  # noqa: E731, B023
        found = groups.withColumn("number", number(F.col("source")))
        if found.groupBy("lang", "number").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return found, number(_filled(source))


def term_counts(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 1) -> DataFrame:
    """(lang, source, term, count, total): occurrences in the group's documents and in the
    language's, of the terms that ``min_docs`` documents of the language hold."""
    spark = df.sparkSession
    groups, number = _numbered_groups(df, lang, source)
    docs = df.select(_filled(text).alias("text"), _filled(lang).alias("lang"), number.alias("source"))
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = cut(_chunk_blocks(docs, buckets), "chunks", compression="zstd")
    tokenized = cut(_tokenized(made.where("bucket is not null"), buckets), "tokenized", compression="zstd")
    totals = tokenized.where("totals is not null").select(F.explode(F.arrays_zip("total_keys", "totals")).alias("x"))
    totals = totals.groupBy(F.col("x.total_keys").alias("key")).agg(F.sum("x.totals").alias("n")).where(F.col("n") >= min_docs)
    bits = spark.sparkContext.broadcast(_filter.bitmap(totals, "key")) if min_docs > 1 else None
    answer = _common_enough(tokenized.where("block is not null").select("block", "first", "sizes", "terms"), bits, min_docs)
    sums = made.where("bucket is null").drop("bucket", "first", "chunks", "counts").groupBy("block").cogroup(answer.groupBy("held_by")).applyInArrow(_sum_block, SUMS)
    of_lang = Window.partitionBy("lang", "term")
    own = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    kept = sums.repartition("lang", "term").withColumns({"_held": F.sum("docs").over(of_lang), "total": F.sum(own).over(of_lang)}).where(F.col("_held") >= min_docs)
    kept = kept.select("lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", "term", F.col("x.sources").alias("number"))
    kept = kept.agg(F.sum("x.counts").alias("count"), F.first("total").alias("total"))
    return kept.join(groups, ["lang", "number"]).select("lang", "source", "term", "count", "total")


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / total), exact."""
    return F.lit(1).cast("long") + F.call_function("div", (count.cast("decimal(19,0)") + PRIOR) * F.lit(SCALE), total)


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    """Sums of differences between the sources of a tile over the terms of a block of
    terms; a row without a term is a source with its share for an empty count."""
    lang, _, low, high = (k.as_py() for k in key)
    given = rows.column("term").is_null()
    bases = rows.filter(given).sort_by("source")
    names, tile = bases.column("source").combine_chunks(), bases.column("tile").to_numpy()
    rows = rows.filter(pc.invert(given))
    term, distinct = _codes(rows.column("term"))
    shares = np.repeat(bases.column("p").to_numpy()[:, None], len(distinct), axis=1)
    shares[pc.index_in(rows.column("source").combine_chunks(), names).to_numpy(), term] = rows.column("p").to_numpy()
    left, right, value = [], [], []
    for i in np.flatnonzero(tile == low):
        others = np.flatnonzero(tile == high)
        if low == high:
            others = others[others > i]
        left.append(np.full(len(others), i))
        right.append(others)
        value.append(np.abs(shares[others] - shares[i]).sum(axis=1))
    join = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
    left, right = join(left), join(right)
    return pa.table({
        "lang": pa.array([lang] * len(left), pa.string()), "source": names.take(pa.array(left)), "item": names.take(pa.array(right)),
        "value": join(value),
    })


def divergence(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): for each two sources of a language the sum over
    all its kept terms of the difference of their shares.

    ``kept(lang, source, term, p)`` for counts above 0, ``groups(lang, source, v, p0)``
    with the language's number of kept terms and the share of an empty count."""
    sizes = groups.groupBy("lang").agg(
        F.greatest(F.lit(1), F.ceil(F.max("v") / TILE_TERMS)).cast("int").alias("salts"),
        F.ceil(F.count("*") / TILE_SOURCES).cast("int").alias("tiles"),
    )
    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    # a source meets its own tile and every other one, each pair of tiles once
    met = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(
        F.least(t, F.col("tile")).alias("low"), F.greatest(t, F.col("tile")).alias("high"))))
    base = (
        groups.join(sizes, "lang").withColumn("tile", tile).withColumn("_m", met)
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .select("lang", "salt", "_m.low", "_m.high", "source", "tile", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"))
    )
    counted = (
        kept.join(sizes, "lang").withColumn("tile", tile).withColumn("_m", met)
        .select("lang", F.pmod(F.xxhash64("term"), F.col("salts")).cast("int").alias("salt"), "_m.low", "_m.high", "source", "tile", "term", "p")
    )
    half = (
        base.unionByName(counted).groupBy("lang", "salt", "low", "high").applyInArrow(_tile, "lang string, source string, item string, value long")
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    )
    return half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def audit(
    df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP,
) -> DataFrame:
    """How sources of one language differ in their terms: part ``pair`` ranks the other
    sources by divergence, part ``term`` the terms that a source has more of than
    its language, at most ``top`` of them."""
    kept = cut(term_counts(df, text, lang, source, min_docs), "terms", compression="zstd")
    of_lang = kept.select("lang", "term", "total").distinct()
    groups = df.select(_filled(lang).alias("lang"), _filled(source).alias("source")).distinct()
    number = of_lang.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    groups = groups.join(own, ["lang", "source"], "left").join(number, "lang", "left").select(
        "lang", "source", zero("v").alias("v"), (zero("n") + PRIOR * zero("v")).alias("of"), (zero("all") + PRIOR * zero("v")).alias("of_lang"),
    )
    groups = cut(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("of"))).otherwise(F.lit(0).cast("long"))), "groups")
    shares = kept.join(groups.select("lang", "source", "of", "of_lang"), ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("count"), F.col("of")).alias("p"), share(F.col("total"), F.col("of_lang")).alias("q"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = divergence(shares.drop("q"), groups).withColumn("rank", F.row_number().over(order))
    over = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    columns = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", "value", "rank"]
    return pairs.select(*columns("pair")).unionByName(over.select(*columns("term")))
