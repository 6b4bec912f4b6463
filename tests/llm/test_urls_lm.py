import collections
import math
import zlib

import numpy as np

from faultline.llm import lm, urls
from tests.llm.helpers import ODD, WORD, frame, lower, prose


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url[url.index("://") + 3:]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = lower(rest[:cut])
    path = rest[cut:]
    path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text), default=None)


URLS = [
    None, "", "no scheme", "http://", "https://A.Example.ORG/es/1?x=1#y", "http://example.org/en/12", "http://example.org/en/2", "http://badexample.org/es/1", "http://x.com/fr/a",
    "http://com/de/1", "http://xcom/de/1", "ftp://u.net/de/1", "http://x.org?a=/es/", "http://x.org#/de/", "http://x.com/fr", "x://y://z.com/de/", "http://é.com/de/%20",
]


def test_rules_by_host_and_path(spark):
    many = URLS + [f"http://h{i}.example.com/{'fr' if i % 2 else 'de'}/{i}" for i in range(40)] + [f"http://h{i}.net/{'fr' if i % 2 else 'de'}/{i}" for i in range(20)]
    df = spark.createDataFrame([(None if i == 1 else i, u, "x", "y") for i, u in enumerate(many)], "page_id long, url string, host string, rule string")
    rows = urls.judge(df).collect()
    assert len(rows) == len(many)
    got = {r.page_id: r for r in rows}
    for i, u in enumerate(many):
        if i == 1:
            continue
        host, path, rule = plain_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule.text), u
        assert got[i].verdict == rule.verdict if rule else got[i].verdict in ("allow", "block")
    # the trees learn the section
    later = [got[len(URLS) + 40 + i].verdict for i in range(20)]
    assert later == ["allow" if i % 2 else "block" for i in range(20)]


def test_urls_without_labelled_ones(spark):
    df = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x")], "page_id long, url string")
    assert [r.verdict for r in urls.judge(df).collect()] == ["allow", "allow"]
    assert urls.judge(df.limit(0)).collect() == []


def test_base_scores_against_plain_counts(spark):
    texts = [*ODD, *(prose(60, i) for i in range(30)), prose(60, 1)]
    ids = [*range(len(texts) - 1), 9]
    docs = frame(spark, texts, ids)
    words = [WORD.findall(lower(t or "")) + [None] for t in texts]
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in ids]
    c = collections.Counter(w for ws, t in zip(words, train) if t for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((i, not t, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, t, ws in zip(ids, train, words))
    got = lm.score(docs).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score(docs.limit(0)).collect() == []


def test_symbols_are_words_and_ends():
    data = np.frombuffer("A  b\nc dé  \t x\ny ".encode(), dtype=np.uint8)
    offs = np.array([0, 5, 5, 8, 10, 12, len(data)])
    x, ends = lm.symbols(data, offs)
    parts = [x[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)]
    assert [p[-1] for p in parts] == [lm.END] * len(parts)
    assert [bytes(p[:-1]).decode() for p in parts] == ["a b", "", "c d", "é", "", "x y"]


def test_tree_counts_contexts_and_distributions_sum_to_one(spark):
    docs = frame(spark, [prose(200, i, 30) for i in range(20)])
    tree = lm.grow(docs.select("text"))
    text = [lower(r.text).encode() for r in docs.collect()]
    step = lambda s: tree.steps[1][tree.steps[0][0, s[0]], s[1]]
    at = step(b"th")
    assert at >= 0 and tree.counts[2][at][ord("e")] == sum(t.count(b"the") for t in text)
    for row, log in tree.finish():
        assert np.allclose((10.0 ** log).sum(axis=1), 1) and (row >= -1).all()


def test_longer_contexts_beat_the_root_on_held_out_text(spark):
    docs = frame(spark, [prose(200, i, 30) for i in range(40)])
    rows = lm.score(docs).collect()
    tree = lm.grow(docs.select("text"), depth=0)
    root = tree.finish()[0][1][0]
    flat = {i: sum(root[b] for b in lower(t).encode()) + root[lm.END] for i, t in ((r.doc_id, r.text) for r in docs.collect())}
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > 0.8 * sum(flat[r.doc_id] for r in held)
