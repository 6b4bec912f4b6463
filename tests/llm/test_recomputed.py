"""Results of the fitted operators and of the pipeline, computed again by a plain reading."""

import itertools
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from faultline.llm import _stats, quality, rules
from tests.llm.helpers import frame, prose
from tests.llm.test_duplicates import shingles, union
from tests.llm.test_quality_rules import corpus

SF = "/root/testdata/sf0.001"


def one(text):
    """Statistics of a text alone."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    m = _stats.measure(data, np.array([0, len(data)]))
    return {k: v[0] for k, v in m.items()}, _stats.features(m)[0]


def test_quality_scores_are_those_of_the_discriminant(spark):
    docs, labels = corpus(spark, 90, 3)
    label = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(r.doc_id, *one(r.text)) for r in docs.collect()]
    weight = {i: m["words"] / (m["words"] + quality.STEADY) for i, m, _ in rows}
    taught = [(i, x) for i, _, x in rows if label.get(i) in (0, 1) and zlib.crc32(str(i).encode()) % 5]
    middle = sum(weight[i] * x for i, x in taught) / sum(weight[i] for i, _ in taught)
    point = lambda i, x: weight[i] * x + (1 - weight[i]) * middle
    of = {k: np.array([point(i, x) for i, x in taught if label[i] == k]) for k in (0, 1)}
    n = len(taught)
    pooled = np.maximum(sum(((z - z.mean(axis=0)) ** 2).sum(axis=0) for z in of.values()) / n, quality.FLOOR)

    def density(k, z):
        cov = (1 - quality.SHRINK) * np.cov(of[k].T, bias=True) + np.diag(quality.SHRINK * pooled + quality.FLOOR)
        away = z - of[k].mean(axis=0)
        return math.log(len(of[k]) / n) - 0.5 * (np.linalg.slogdet(cov)[1] + away @ np.linalg.solve(cov, away))

    got = {r.doc_id: r.score for r in quality.judged(docs, labels).collect()}
    for i, _, x in rows:
        apart = np.clip(density(0, point(i, x)) - density(1, point(i, x)), -500, 500)
        assert got[i] == pytest.approx(1 / (1 + math.exp(apart)), rel=1e-5, abs=1e-9)


def test_anomalies_are_path_lengths_and_the_cut_is_the_cheapest(spark):
    docs, labels = corpus(spark, 150, 6)
    forest = rules.fit(docs)
    rows = docs.collect()

    def path(tree, x):
        feature, cut, left, right = tree
        at = 0
        while feature[at] >= 0:
            at = left[at] if x[feature[at]] < cut[at] else right[at]
        return cut[at]  # a leaf's depth and what a search among its rows would add

    usual = float(rules.mean_path(rules.SAMPLE))
    measured = rules.measure(docs, forest)
    got = {r.doc_id: r.anomaly for r in measured.collect()}
    for r in rows:
        x = one(r.text)[1][rules.USED]
        assert got[r.doc_id] == pytest.approx(2 ** (-sum(path(t, x) for t in forest) / len(forest) / usual))
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and r.doc_id in got}
    base = {r.doc_id for r in measured.where(rules.BASE_FAILED).collect()}
    value = {k: [got[i] for i, q in known.items() if q == k and i not in base] for k in (0, 1)}
    share = lambda k, c: sum(v >= c for v in value[k]) / len(value[k])
    cost = lambda c: rules.GOOD_WEIGHT * share(1, c) - share(0, c)
    cut = rules.calibrate(measured, labels)
    assert cost(cut) == pytest.approx(min(cost(s / rules.STEPS) for s in range(rules.STEPS + 2)))
    kept = {r.doc_id: r.kept for r in rules.judge(docs, labels).collect()}
    assert kept == {i: i not in base and got[i] < cut for i in got}


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_contents_of_every_stage(spark):
    import corpus_pipeline
    from faultline.llm.queries import word_bpe_path

    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = [row.text for row in docs.where("length(text) between 600 and 2000").orderBy("doc_id").limit(40).collect()]
    some = [" ".join(reversed(t.split(" "))) for t in some]  # no copies of the originals
    kept = [f"{t} api_key: 'abcd1234efgh{k}' and AKIA{'Q' * 16}" for k, t in enumerate(some)]
    texts = [t := prose(80, 1), t.upper(), t + " more", prose(80, 2), *kept]
    near = frame(spark, texts, [90001 + k for k in range(len(texts))]).select(docs.columns)
    now = docs.unionByName(near).cache()
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        at[name] = now.collect()
        now = stage(spark, now, SF).cache()
    first, good, single, clean, mixed = (at[name] for name, _ in corpus_pipeline.STAGES)
    scores = {r.doc_id: r.predicted for r in quality.judged(docs.unionByName(near), spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert sorted(r.doc_id for r in good) == sorted(r.doc_id for r in first if scores[r.doc_id])
    # the smallest id of each group of near copies
    sets = {r.doc_id: shingles(r.text) for r in good}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    group = union({i: i for i in sets}, linked)
    assert sorted(r.doc_id for r in single) == sorted(i for i, g in group.items() if i == g or not sets[i])
    assert 90001 not in sets or {90002, 90003}.isdisjoint(r.doc_id for r in single)
    # secrets are gone, all else stays
    secret = [
        re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}""", re.I),
        re.compile("AKIA[A-Z0-9]{12,}"), re.compile("[0-9a-f]{32,}"),
    ]
    before = {r.doc_id: r.text for r in single}
    found = 0
    for r in clean:
        held = any(p.search(before[r.doc_id]) for p in secret)
        found += held
        assert not any(p.search(r.text) for p in secret) and r.n_chars == len(r.text)
        assert ("[SECRET]" in r.text) if held else (r.text == before[r.doc_id] or "[SECRET]" in r.text)
        assert all(part in before[r.doc_id] for part in r.text.split("[SECRET]"))
    assert found and len(clean) == len(single)
    # every document at least once, none changed
    assert {tuple(r) for r in mixed} == {tuple(r) for r in clean} and max(Counter(r.doc_id for r in mixed).values()) > 1
    library = tokenizers.Tokenizer.from_file(word_bpe_path())
    ids = Counter((r.doc_id, tuple(r.ids)) for r in now.collect())
    assert ids == Counter((r.doc_id, tuple(library.encode(r.text, add_special_tokens=False).ids)) for r in mixed)
