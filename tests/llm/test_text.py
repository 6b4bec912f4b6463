"""The hash of spans, on texts that a polynomial modulo a power of two takes for equal."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from faultline.llm import _stats, _text, jaccard, lm, repeats
from tests.llm.helpers import frame


def thue_morse(n, swap=False):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


PAIRS = [(thue_morse(n), thue_morse(n, True)) for n in (1024, 2048)]


def hashes(text, spans):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    start, end = (np.array(x, dtype=np.int64) for x in zip(*spans))
    return _text.span_hash(_text.prefix_hash(data), start, end)


@pytest.mark.parametrize("a, b", [*PAIRS, *((x.replace("a", "xay").replace("b", "xby"), y.replace("a", "xay").replace("b", "xby")) for x, y in PAIRS)])
def test_complementary_words_differ(a, b):
    x, y = hashes(a + " " + b, [(0, len(a)), (len(a) + 1, len(a) + len(b) + 1)])
    assert x != y
    data = np.frombuffer(f"{a}\n{b}\n{a}".encode(), dtype=np.uint8)
    m = _stats.measure(data, np.array([0, len(data)]))
    assert m["dup_lines"][0] == 1 and m["types"][0] == 2


def test_spans_are_equal_exactly_where_their_bytes_are():
    rnd = random.Random(4)
    text = "".join(rnd.choice("ab") for _ in range(3000))
    spans = [(s, s + rnd.randint(0, 12)) for s in (rnd.randrange(2980) for _ in range(4000))]
    seen = {}
    for (s, e), h in zip(spans, hashes(text, spans)):
        assert seen.setdefault(text[s:e], h) == h
    assert len(set(seen.values())) == len(seen)
    assert hashes("x" + "q" * 2_000_000 + "x", [(1, 1_000_001), (1_000_001, 2_000_001)]).tolist().count(0) == 0
    x, y, z = hashes("x" + "q" * 2_000_000 + "x", [(1, 1_000_001), (1_000_001, 2_000_001), (0, 1_000_000)])
    assert x == y != z


def test_operators_tell_complementary_words_apart(spark):
    texts = [t for pair in PAIRS for t in pair]
    docs = frame(spark, texts, [1, 2, 3, 4])
    assert {r.doc_id: r.component_id for r in jaccard.join(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    times = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    covered = [{j for i in range(len(t) - 199) if times[t[i:i + 200]] > 1 for j in range(i, i + 200)} for t in texts]
    assert {r.doc_id: r.n_removed for r in repeats.report(docs).collect()} == {k + 1: len(c) for k, c in enumerate(covered)}
    held, train = (next(i for i in range(1, 200) if (zlib.crc32(str(i).encode()) % 7 == 2) == out) for out in (True, False))
    got = {r.doc_id: r.n_known for r in lm.score(frame(spark, list(PAIRS[0]), [train, held])).collect()}
    assert got == {train: 2, held: 1}
