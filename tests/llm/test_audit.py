import random
import re
from collections import Counter

from faultline.llm import audit
from tests.llm.helpers import ODD, lower

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, count string, value double"


def brute(rows, min_docs, top):
    counts, docs, groups = {}, {}, set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        found = Counter(TERM.findall(lower(text)))
        counts.setdefault((lang, source), Counter()).update(found)
        docs.setdefault(lang, Counter()).update(found.keys())
    out = []
    order = lambda x: (-x[1], x[0].encode())
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = {s: counts[lang, s] for g, s in groups if g == lang}
        whole = Counter()
        for c in sources.values():
            whole.update(c)

        def share(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)  # noqa: B023
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // total for t in kept}  # noqa: B023

        p, q = {s: share(c) for s, c in sources.items()}, share(whole)
        for s in sources:
            pair = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, p[s][t] - q[t]) for t in kept if sources[s][t] > 0 and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pair, key=order)), ("term", sorted(term, key=order)[:top])):
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(1, *r, "x", "x", 1.0) for r in rows], SCHEMA)


def rows_of(n, seed):
    rnd = random.Random(seed)
    words = ["Über", "the", "THE", "über,", "foo-bar", "foo.", "(foo)", "naïve", "日本", "x1y", "42", "a b", "it's", "end"]
    langs, sources = ["en", "de", "", None], ["s1", "s2", "s3", "é", "", None]
    return [(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))), rnd.choice(langs), rnd.choice(sources)) for _ in range(n)]


def test_rows_equal_brute_force(spark):
    rows = rows_of(300, 1) + [(t, "fr", "s1") for t in ODD] + [(t, "fr", "s2") for t in ODD] + [("lonely", "it", "s9"), (None, None, None), ("", "pt", "a"), ("7 8", "pt", "b")]
    rows += [(" ".join("".join(chr(97 + int(c)) for c in str(k)) for k in range(s, 12000, 2)), "es", "s1") for s in (0, 1)]  # a long list of chunks
    rows += rows[:40]
    rnd = random.Random(2)
    rnd.shuffle(rows)
    df = table(spark, rows).repartition(4)
    for min_docs, top in ((30, 50), (1, 3), (10**6, 5)):
        got = sorted(tuple(r) for r in audit.audit(df, min_docs=min_docs, top=top).collect())
        assert got == brute(rows, min_docs, top)


def test_tiles_of_sources_and_terms_change_nothing(spark, monkeypatch):
    rows = [(f"w{chr(97 + k % 26)} common {chr(97 + k % 7) * 3}", "en", f"s{k % 23}") for k in range(400)]
    want = brute(rows, 1, 50)
    monkeypatch.setattr(audit, "TILE_SOURCES", 5)
    monkeypatch.setattr(audit, "TILE_TERMS", 4)
    assert sorted(tuple(r) for r in audit.audit(table(spark, rows), min_docs=1).collect()) == want


def test_shares_are_exact_for_counts_beyond_64_bits(spark):
    df = spark.createDataFrame([(8 * 10**11, 9 * 10**12 + 7)], "c long, n long")
    (got,) = df.select(audit.share(df.c, df.n)).first()
    assert got == 1 + 1_000_000_000 * (8 * 10**11 + 5) // (9 * 10**12 + 7)


def test_empty_table(spark):
    assert audit.audit(table(spark, []).limit(0)).collect() == []
    assert audit.term_counts(table(spark, [])).collect() == []


def test_blocks_hold_whole_documents_across_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(audit, "BLOCK", 100)
    texts = ["x" * (7 * k % 90) for k in range(50)] + ["y" * 1000, "", "z"]
    batches = [pa.record_batch({"text": texts[k:k + 9]}) for k in range(0, len(texts), 9)]
    blocks = [t.column("text").to_pylist() for t in audit._blocks_of(iter(batches))]
    assert [t for b in blocks for t in b] == texts and all(len("".join(b[:-1])) < 100 for b in blocks)
    assert len(blocks) < 35 and list(audit._blocks_of(iter([]))) == []


def test_lists_of_numbers_come_back():
    import numpy as np

    rnd = random.Random(9)
    rows = [[rnd.choice([0, 1, 254, 255, 256, 65534, 65535, 65536, 10**6]) for _ in range(rnd.randint(0, 6))] for _ in range(50)]
    ends = np.cumsum([0, *map(len, rows)])
    x = np.array([v for r in rows for v in r])
    for kind in (np.uint8, np.uint16):
        small, wide = audit._narrow(x, ends, kind)
        for a, b in ((0, 50), (7, 31), (50, 50)):
            got, offs = audit._widened(small.slice(a, b - a), wide.slice(a, b - a), kind)
            assert [got[p:q].tolist() for p, q in zip(offs, offs[1:])] == rows[a:b]


def test_sums_by_table_and_by_sorting_agree(monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(2)
    key, n = rnd.integers(0, 90, 500), rnd.integers(1, 9, 500)
    want = audit._summed(key, n, 90)
    monkeypatch.setattr(audit, "DENSE", 0)
    got = audit._summed(key, n, 90)
    assert all((a == b).all() for a, b in zip(want, got)) and want[1].sum() == n.sum()
    empty = np.zeros(0, np.int64)
    assert [len(x) for x in audit._summed(empty, empty, 90)] == [0, 0]
