"""Secret scans through a trigram inverted index.

Each rule's regex is turned into a Boolean query over the trigrams that every
match must hold (lower-cased ASCII, so letter case doesn't matter).  Every
block of documents gets postings of the trigrams that the rules ask for, the
queries intersect and unite them, and the regex runs on the candidates only.
A rule without mandatory trigrams, such as a run of hexadecimal digits, scans
all documents.

Blocks are built inside the tasks that read them: nothing is shuffled, and the
rules are the only thing that every task needs.

Defined results: a null or empty text has no spans; rows and their other
columns, repeats included, stay; spans are in code points, end exclusive,
ordered by start, then by the rules' order.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm import _text

MOST = 64  # strings that an exact set may hold before it is cut to its ends


@dataclass(frozen=True)
class Rule:
    """A regex (ASCII classes); a match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# Fixed patterns of the base kinds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
# Common public token formats, beside the base kinds.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + MORE


# A query is True (no demand), a trigram, or ("and" | "or", parts).
def both(a, b):
    if a is True or b is True:
        return b if a is True else a
    return a if a == b else ("and", (a, b))


def either(parts: Iterable):
    parts = list(dict.fromkeys(parts))
    if not parts or True in parts:
        return True
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def grams_of(strings: Iterable[str]):
    """What a text holds if it holds one of the strings."""
    found = []
    for s in strings:
        raw, need = s.encode().lower(), True
        for i in range(len(raw) - 2):
            need = both(need, raw[i:i + 3])
        found.append(need)
    return either(found)


@dataclass(frozen=True)
class Part:
    """What is known of a subexpression's matches: all of them (``exact``), or
    how they begin and end, and a query that their text satisfies."""

    exact: frozenset | None
    head: frozenset
    tail: frozenset
    need: object = True

    @staticmethod
    def of(strings: Iterable[str]) -> Part:
        s = frozenset(strings)
        return Part(s, s, s) if len(s) <= MOST else Part.open(s, s, grams_of(s))

    @staticmethod
    def open(head: frozenset, tail: frozenset, need) -> Part:
        return Part(None, frozenset(x[:3] for x in head), frozenset(x[-3:] for x in tail), need)

    def loosen(self) -> Part:
        if self.exact is None:
            return self
        return Part.open(self.exact, self.exact, both(self.need, grams_of(self.exact)))


ANY = Part(None, frozenset([""]), frozenset([""]))


def then(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST:
        return Part.of(x + y for x in a.exact for y in b.exact)
    bridge = True
    if len(a.tail) * len(b.head) <= MOST * 4:
        bridge = grams_of(x + y for x in a.tail for y in b.head)
    head = frozenset(x + y for x in a.exact for y in b.head) if a.exact is not None else a.head
    tail = frozenset(x + y for x in a.tail for y in b.exact) if b.exact is not None else b.tail
    a, b = a.loosen(), b.loosen()
    return Part.open(head if len(head) <= MOST else frozenset([""]), tail if len(tail) <= MOST else frozenset([""]), both(both(a.need, b.need), bridge))


def _known(tree) -> Part:
    out = Part.of([""])
    for op, arg in tree:
        if op is C.LITERAL:
            part = Part.of([chr(arg).lower() if arg < 128 else chr(arg)])
        elif op is C.IN:
            chars: set[str] | None = set()
            for kind, x in arg:
                if kind is C.LITERAL and chars is not None:
                    chars.add(chr(x).lower() if x < 128 else chr(x))
                elif kind is C.RANGE and chars is not None and x[1] - x[0] < 8 and x[1] < 128:
                    chars |= {chr(i).lower() for i in range(x[0], x[1] + 1)}
                else:
                    chars = None
                    break
            part = Part.of(chars) if chars and len(chars) <= 8 else ANY
        elif op is C.SUBPATTERN:
            part = _known(arg[3])
        elif op is C.BRANCH:
            parts = [_known(x) for x in arg[1]]
            if all(p.exact is not None for p in parts):
                part = Part.of(s for p in parts for s in p.exact)
            else:
                parts = [p.loosen() for p in parts]
                part = Part.open(frozenset().union(*(p.head for p in parts)), frozenset().union(*(p.tail for p in parts)), either(p.need for p in parts))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = arg
            p = _known(inner)
            if low == 0:
                part = Part.of({"", *p.exact}) if high == 1 and p.exact is not None else ANY
            else:
                part = p
                for _ in range(min(low, 3) - 1):
                    part = then(part, p)
                if high != low or low > 3:
                    loose = part.loosen()
                    part = Part.open(loose.head, loose.tail, loose.need)
        elif op is C.AT:
            part = Part.of([""])
        else:
            part = ANY
        out = then(out, part)
    return out


def trigram_query(pattern: str):
    """Boolean query that the text of every match satisfies; True if there is none."""
    return _known(_parser.parse(pattern, re.ASCII)).loosen().need


def wanted(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(wanted, query[1]))


class Index:
    """Postings, for one block of texts, of the trigrams that the queries name."""

    def __init__(self, grams: Iterable[bytes]):
        self.grams = sorted(grams)
        self.slot = np.zeros(1 << 24, dtype=np.uint16)
        for k, g in enumerate(self.grams, 1):
            self.slot[g[0] << 16 | g[1] << 8 | g[2]] = k

    def postings(self, data: np.ndarray, offs: np.ndarray) -> dict[bytes, np.ndarray]:
        """For each trigram the sorted rows that hold it."""
        none = np.zeros(0, np.int64)
        if len(data) < 3:
            return dict.fromkeys(self.grams, none)
        low = _text.LOWER[data].astype(np.uint32)
        slot = self.slot[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        at = np.flatnonzero(slot)
        row = np.searchsorted(offs, at, "right") - 1
        within = at + 3 <= offs[row + 1]
        n = len(offs) - 1
        pairs = np.unique(slot[at[within]].astype(np.int64) * n + row[within])
        gram, row = pairs // n, pairs % n
        cuts = np.searchsorted(gram, np.arange(1, len(self.grams) + 2))
        return {g: row[cuts[k]:cuts[k + 1]] for k, g in enumerate(self.grams)}


def answer(query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Rows that satisfy the query: intersections and unions of postings."""
    if query is True:
        return np.arange(n)
    if isinstance(query, bytes):
        return postings[query]
    kind, parts = query
    rows = [answer(p, postings, n) for p in parts]
    out = rows[0]
    for r in rows[1:]:
        out = np.intersect1d(out, r, assume_unique=True) if kind == "and" else np.union1d(out, r)
    return out


def matcher(rule: Rule) -> re.Pattern:
    # a run of one class is maximal, so asking for its least length finds the same runs faster
    if rule.group == 0 and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):
        return re.compile(f"{rule.pattern[:-1]}{{{rule.least},}}", re.ASCII)
    return re.compile(rule.pattern, re.ASCII)


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", out: str = "spans") -> DataFrame:
    """``df`` with ``out``: an array of (kind, start, end), leftmost and
    non-overlapping per kind (it replaces a column of that name)."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, T.ArrayType(span))])
    keep = [f.name for f in schema.fields if f.name != out]
    asked = [trigram_query(r.pattern) for r in rules]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(set().union(*map(wanted, asked)))
        verify = [matcher(r) for r in rules]
        for batch in batches:
            for a, b, data, offs in _text.chunks(batch, text):
                postings = index.postings(data, offs)
                block = batch.slice(a, b - a)
                texts = block.column(text).to_pylist()
                found: list[list] = [[] for _ in texts]
                for k, (rule, query, regex) in enumerate(zip(rules, asked, verify)):
                    for i in answer(query, postings, len(texts)).tolist():
                        if t := texts[i]:
                            found[i] += [(m.start(), k, m.end()) for m in regex.finditer(t) if m.end(rule.group) - m.start(rule.group) >= rule.least]
                spans = pa.array([[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(f)] for f in found], kind)
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in keep), spans], names=[*keep, out])

    return df.mapInArrow(run, schema)


def listed(spans: str | Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and digest of the base kinds and the list of all spans, per document."""
    found = scan(df.select(id_col, text), RULES, text).drop(text)
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        id_col,
        *(count(r.kind).alias(f"n_{r.kind}") for r in BASE),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


def redact(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every found span, overlapping ones as one, replaced by ``mark``.
    Texts without spans and nulls stay as they are."""
    found = scan(df, rules, text, "__spans")

    # spans come by start: cut the text at each one that begins past the last end
    piece = F.aggregate(
        F.col("__spans"),
        F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["done"], F.substr(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(acc["done"]).alias("done"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["done"], F.substr(F.col(text), (acc["at"] + 1).cast("int"))),
    )
    return found.withColumn(text, F.when(F.size("__spans") > 0, piece).otherwise(F.col(text))).select(*df.columns)
