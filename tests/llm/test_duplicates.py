import collections
import hashlib
import random

import numpy as np
import pytest

from faultline.llm import _components, jaccard, neardup, repeats
from tests.llm.helpers import ODD, WORD, frame, lower, prose


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def union(parent, pairs):
    for a, b in pairs:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {x: find(parent, x) for x in parent}


def test_components_of_random_graphs_and_chains(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 50)]
    df = spark.createDataFrame(edges + [(None, 1), (7, 7)], "a long, b long")
    want = union({x: x for e in edges for x in e}, edges)
    got = {r.node: r.component for r in _components.components(df).collect()}
    assert got == {x: c for x, c in want.items() if any(x in e and e[0] != e[1] for e in edges)}


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def near_copies(seed, n=10):
    rnd = random.Random(seed)
    words = prose(rnd.choice([8, 40, 90, 300]), seed, 5000).split()
    out = [" ".join(words)]
    for k in range(n):
        copy = list(words)
        for _ in range(rnd.randint(0, max(1, len(words) // 18))):
            copy[rnd.randrange(len(copy))] = f"edit{k}"
        out.append(" ".join(copy).upper() if k == 0 else " ".join(copy))
    return out


def check_join(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    s = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j])]
    group = union({i: i for i in range(len(s))}, pairs)
    least = {}
    for i, g in group.items():
        if ids[i] is not None:
            least[g] = min(least.get(g, ids[i]), ids[i])
    want = collections.Counter((ids[i], len(s[i]), least.get(group[i])) for i in range(len(s)))
    assert collections.Counter(map(tuple, jaccard.join(frame(spark, texts, ids)).collect())) == want


def test_jaccard_components_against_brute_force(spark):
    texts = [*ODD, "a b c", "A  b\nc", "a b c d"] + [t for i in range(14) for t in near_copies(i)]
    shared = prose(60, 99)
    texts += [f"{shared} {prose(40, 200 + i, 5000)}" for i in range(12)]
    check_join(spark, texts)


def test_jaccard_with_repeated_and_null_ids(spark):
    texts = near_copies(3) + near_copies(4)[:2] + ["alone here today"]
    check_join(spark, texts, [5, 5, *range(20, 28), None, None, 40, 41])
    assert jaccard.join(frame(spark, texts).limit(0)).collect() == []


def test_jaccard_with_a_crowd_under_one_key(spark):
    words = prose(60, 7, 5000).split()
    texts = []
    for i in range(150):
        copy = list(words)
        copy[i % 55] = f"edit{i}"
        texts.append(" ".join(copy))
    check_join(spark, texts)


def test_jaccard_links_a_set_to_a_crowd_of_another_chunk(spark):
    """Only one of the crowd, which is one component, is linked to the set, and not the one that stands for it."""
    words = prose(304, 31, 100000).split()
    crowd = [" ".join([*words, *(f"own{i}x{k}" for k in range(61))]) for i in range(130)]
    texts = [*crowd[:65], " ".join(words), *crowd[65:], "a " * jaccard._text.CHUNK, " ".join(words[:268])]
    assert (len(shingles(texts[65])), len(shingles(texts[0])), len(shingles(texts[-1]))) == (300, 361, 264)
    got = {r.doc_id: r.component_id for r in jaccard.join(frame(spark, texts).coalesce(1)).collect()}
    assert got == {i: 131 if i == 131 else 0 for i in range(133)}


def test_jaccard_of_many_short_texts_of_one_template(spark, monkeypatch):
    """More sets than a block holds, of a few elements each, all under shared keys and mostly apart."""
    monkeypatch.setattr(jaccard, "ROWS", 256)
    head = " ".join(f"t{k}" for k in range(10))
    texts = [f"{head} a{k} b{k}" for k in range(1500)] + [f"{head} a{k} b{k} c" for k in range(0, 1500, 100)]
    got = {r.doc_id: r.component_id for r in jaccard.join(frame(spark, texts)).collect()}
    # eight shingles, six of them the template's: 6 of 10 for strangers, 8 of 9 for a text with one more word
    assert got == {**{k: k for k in range(1500)}, **{1500 + k: 100 * k for k in range(15)}}


def test_linked_sets_share_a_key_that_one_of_them_takes():
    """The pigeonhole, without any frequencies: units suffice, and linked pairs share a unit's key."""
    rnd = np.random.default_rng(5)
    for n in (3, 10, 31, 32, 40, 63, 64, 100, 500):
        for _ in range(20):
            base = rnd.integers(0, 2**63, n, dtype=np.uint64)
            drop = int(rnd.integers(0, max(1, n // 5)))
            other = base[drop:]
            if 100 * len(other) < 75 * n:
                continue
            h = np.concatenate([np.sort(base), np.sort(other)])
            row = np.repeat([0, 1], [n, len(other)])
            size = np.array([n, len(other)])
            key, owner, need, unit = jaccard.index(h, row, size)
            mine = need[(owner == 0) & (need != jaccard.NO_PROBE)]
            assert (mine == mine[0]).all() and mine[0] <= 0
            assert set(key[(owner == 0) & (need != jaccard.NO_PROBE)].tolist()) & set(key[owner == 1].tolist())


def test_keep_one_of_each_group(spark):
    texts = near_copies(1) + near_copies(2) + ["", None]
    docs = frame(spark, texts)
    groups = sorted({r.component_id for r in jaccard.join(docs).collect()})
    more = docs.unionByName(docs.where("doc_id < 3")).unionByName(frame(spark, [texts[0], "all alone here", "all alone here"], [None, None, None]))
    kept = jaccard.keep_one(more)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.text if r.doc_id is None else "") for r in kept.collect())) == [*((False, g, "") for g in groups), (True, 0, "all alone here")]


def removed(texts):
    raw = [(t or "").encode() for t in texts]
    n = collections.Counter(t[k:k + 200] for t in raw for k in range(len(t) - 199))
    out = []
    for t in raw:
        gone, until = [], 0
        for k in range(len(t)):
            if k + 200 <= len(t) and n[t[k:k + 200]] > 1:
                until = k + 200
            gone.append(k < until)
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check_repeats(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    want = collections.Counter((i, *r) for i, r in zip(ids, removed(texts)))
    assert collections.Counter(map(tuple, repeats.report(frame(spark, texts, ids)).collect())) == want


def test_repeated_strings_against_brute_force(spark):
    passage, line = prose(70, 50), prose(31, 51)
    texts = [t for t in ODD if not t or len(t) < 20000] + ["of " * 200, "x" * 199, "y" * 200, "y" * 201, "é" * 250]
    for i in range(40):
        body = prose(120, i, 3000)
        k = 7 * i % 300
        texts.append(body[:k] + passage + body[k:] if i % 3 else body + line[:150 + 3 * i] + body[:40 * (i % 9)])
    texts += [texts[20][5:400], texts[21], texts[21] + " tail", "head " + texts[22], texts[23][:260]]
    check_repeats(spark, texts)


def test_repeats_with_a_crowd_and_odd_ids(spark):
    passage = prose(40, 60)
    texts = [prose(30, 300 + i, 3000) + passage[i % 9:] + prose(30, 500 + i, 3000) for i in range(180)] + [passage, passage]
    check_repeats(spark, texts, [None, 3, 3, *range(10, 10 + len(texts) - 3)])
    assert repeats.report(frame(spark, texts).limit(0)).collect() == []


def test_repeats_of_one_that_stands_for_a_crowd(spark):
    """Its surroundings occur again in another chunk only, where no anchor is open; a window of them stands in its own crowd."""
    rnd = random.Random(61)
    lines = ["".join(rnd.choices("abcdefghijklmnop", k=repeats.SEED)) for _ in range(20000)]
    data = np.frombuffer("".join(lines).encode(), np.uint8)
    at = np.arange(len(lines)) * repeats.SEED
    line = lines[int(repeats._text.span_hash(repeats._text.prefix_hash(data), at, at + repeats.SEED).argmin())]
    side = [prose(80, 620 + i, 3000) for i in range(160)]
    whole = side[0] + line + side[1]
    window = side[0][-80:] + line + side[1][:80]
    texts = [whole, *(side[2 * i] + line + side[2 * i + 1] for i in range(1, 78)), side[156] + window + side[157]]
    texts += ["a " * (1 << 20), f"{side[158]}{whole}{side[159]}"]
    got = {r.doc_id: tuple(r)[1:] for r in repeats.report(frame(spark, texts).coalesce(1)).collect()}
    assert got == dict(enumerate(removed(texts)))
    assert got[78][1] >= 200


def brute_links(rows, threshold=0.93):
    def sound(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links, pairs = [0] * len(rows), []
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows):
            if i != j and sound(v, a) and sound(w, b) and a == b and len(v) == len(w):
                x, y = (np.array(u, float) / np.abs(u).max() for u in (v, w))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] += 1
                    pairs.append((i, j))
    group = union({i: i for i in range(len(rows))}, pairs)
    least = {}
    for i, g in group.items():
        if rows[i][0] is not None:
            least[g] = min(least.get(g, rows[i][0]), rows[i][0])
    return collections.Counter((r[0], n, least.get(group[i]), r[0] == least.get(group[i])) for i, (r, n) in enumerate(zip(rows, links)))


@pytest.mark.parametrize("block", [neardup.BLOCK, 16])
def test_range_join_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rnd = np.random.default_rng(8)
    rows = []
    for g in range(30):
        centre = rnd.normal(size=6)
        for k in range(int(rnd.integers(1, 9))):
            rows.append((len(rows), [float(x) for x in centre + rnd.normal(size=6) * 0.2 * (k % 3)], int(g % 2)))
    hot = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    rows += [(1000 + i, hot, 1) for i in range(30)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 6, 1), (2003, [1.0, float("nan")], 1), (2004, [1.0, None], 1), (2005, [float("inf"), 1.0], 1), (2006, hot, None), (2007, hot[:3], 1), (2008, hot[:3], 1), (None, [9.0, -1.0, 0.0, 0.0, 0.0, 0.0], 0), (1000, hot, 1), (2009, [x * 1e200 for x in hot], 1)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<double>, label int, node string, n long")
    got = neardup.join(df).collect()
    assert collections.Counter((r.vec_id, r.n_links, r.component_id, bool(r.kept)) for r in got) == brute_links(rows)
    assert neardup.join(df.limit(0)).collect() == []


def test_copies_of_vectors_follow_blocks_not_cells(spark, monkeypatch):
    """Vectors without structure reach every cell, and travel once to each pair of blocks."""
    monkeypatch.setattr(neardup, "PIVOTS", (16, 16))
    monkeypatch.setattr(neardup, "BLOCK", 150)
    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(rnd.normal(size=(600, 64)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    _, nodes = neardup._nodes(df, "vec_id", "embedding", "label")
    celled = neardup._celled(nodes, neardup._pivots(nodes), neardup.THRESHOLD)
    assert celled.count() == 600  # one row a cell before
    assert neardup._dealt(celled).count() <= 2 * 600 and celled.schema["v"].dataType.simpleString() == "array<float>"
