import hashlib
import random
import zlib

from faultline.llm import ctph
from tests.llm.helpers import ODD, frame, prose


def plain_fingerprint(text):
    """The fingerprint byte by byte, each window hashed anew."""
    raw = text.encode()
    if not raw:
        return "0:::"
    ends = []
    for p in range(len(raw)):
        roll = 0
        for t in range(ctph.WINDOW):
            roll ^= int(ctph._TABLES[t][raw[p - t] if p >= t else 0])
        ends.append(32 if roll == 0 else (roll & -roll).bit_length() - 1)
    base = 1
    while sum(e >= base for e in ends) >= ctph.MOST:
        base += 1
    out = [str(base)]
    for k in range(base, base + ctph.LEVELS):
        cuts = [0, *(p + 1 for p, e in enumerate(ends) if e >= k)]
        if cuts[-1] < len(raw):
            cuts.append(len(raw))
        out.append("".join(ctph.LETTERS[zlib.crc32(raw[a:b]) & 63] for a, b in zip(cuts, cuts[1:])))
    return ":".join(out)


def plain_distance(a, b):
    """Insertions and deletions, by the textbook table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last if x == y else 1 + min(row[j], row[j + 1])
    return row[-1]


TEXTS = ODD + ["ab", "\x00" * 50, "日本語 " * 90] + [prose(n, n) for n in (3, 20, 90, 400, 3000)]


def test_fingerprints_equal_a_plain_reading():
    raw = [t.encode() for t in TEXTS if t is not None]
    assert ctph.fingerprints(raw) == [plain_fingerprint(t) for t in TEXTS if t is not None]
    assert ctph.fingerprints([raw[-1]]) == ctph.fingerprints(raw)[-1:] and ctph.fingerprints([]) == []
    assert all(max(map(len, f.split(":")[1:])) <= ctph.MOST for f in ctph.fingerprints(raw))


def test_distance_is_the_edit_distance():
    rnd = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 64))) for _ in range(2))
        assert len(a) + len(b) - 2 * ctph.common(a, b) == plain_distance(a, b)


def test_likeness_tells_edits_from_strangers():
    texts = [prose(200 + 7 * s, s, words=3000) for s in range(60)]
    prints = ctph.fingerprints([t.encode() for t in texts])
    changed = ctph.fingerprints([ctph.edited(t, f).encode() for t, f in zip(texts, texts[1:] + texts[:1])])
    touched = ctph.fingerprints([(t[:300] + "XYZ" + t[310:]).encode() for t in texts])
    assert all(ctph.likeness(a, a) == 1 for a in prints)
    # the levels of a text and of the edited one may lie too far apart for a few
    assert sum(ctph.likeness(a, b) > 0.3 for a, b in zip(prints, changed)) >= 57
    assert min(ctph.likeness(a, b) for a, b in zip(prints, touched)) > 0.6
    assert sum(ctph.likeness(a, b) > 0.2 for a, b in zip(prints, prints[1:])) <= 3
    assert all(ctph.likeness(a, b) == ctph.likeness(b, a) for a, b in zip(prints, changed))


def brute(rows):
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        changed = t[:len(t) - half] + after[:half]
        p, e, n = (plain_fingerprint(x) for x in (t, changed, after))
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), p, e, ctph.likeness(p, e), ctph.likeness(p, n)))
    return out


def test_tables_with_odd_rows(spark):
    texts = TEXTS + [prose(30, s) for s in range(25)]
    ids = [3 * k + 1 for k in range(len(texts) - 1)] + [None]
    rows = list(zip(ids, texts))
    want = brute(sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0])))
    random.Random(1).shuffle(rows)
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3)
    for n in (1, 4, 50):  # one range, several, more than rows
        got = ctph.edits(docs, partitions=n)
        assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_repeated_ids_and_rows_follow_each_other(spark):
    rows = [(1, "a" * 40), (1, prose(30, 1)), (1, prose(30, 1)), (2, prose(20, 2)), (2, prose(20, 2))] * 20
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    hashes = {t: spark.sql("select xxhash64(:t) h", args={"t": t}).first().h for _, t in rows}
    want = brute(sorted(rows, key=lambda r: (r[0], hashes[r[1]])))
    assert sorted(map(tuple, ctph.edits(docs, partitions=6).collect())) == sorted(want)


def test_one_row_and_none(spark):
    docs = frame(spark, ["only text here"], [5])
    (row,) = ctph.edits(docs).collect()
    assert (row.doc_id, row.near_next) == (5, 1.0)
    assert row.edited_sha256 == hashlib.sha256(b"only text" [:7] + b"only te").hexdigest()
    assert ctph.edits(docs.limit(0)).collect() == []


def test_fingerprint_keeps_columns(spark):
    docs = frame(spark, TEXTS).withColumnRenamed("spans", "fingerprint")
    out = ctph.fingerprint(docs)
    assert sorted(out.columns) == sorted(docs.columns)
    assert {r.doc_id: r.fingerprint for r in out.collect()} == {k: plain_fingerprint(t or "") for k, t in enumerate(TEXTS)}
