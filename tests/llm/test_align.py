import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from faultline.llm import align
from tests.llm.helpers import ODD, frame, prose

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
A, B = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))
TEXTS = [
    "<|endoftext|> <s>x</s> <0x41> <unk>", "a ▁ mark that comes back as a space", "  two  blanks\n\n\tand tabs ", "naïve café — “quotes” … 12345.678",
    "日本語テキスト 🙂👩‍👩‍👧 ½", "straightforward tokenization internationalization", "\x00\x01\r\n", " ", "x" * 700 + " y " * 300,
]


def brute(texts):
    """Groups, links and counts from byte offsets, token by token."""
    ta, tb = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    shown = {c: i for i, c in enumerate(align.byte_alphabet())}
    out, held = [], Counter()
    for t in texts:
        ids = [], []
        if t:
            a, b = ta.encode(" " + t, add_special_tokens=False).ids, tb.encode(t)
            raw_a = [bytes(shown[c] for c in ta.id_to_token(i)) for i in a]
            raw_b = [bytes([int(tb.id_to_piece(i)[3:-1], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + t).encode():
                ids = a, b
        at = [], []
        for k in range(2 if ids[0] else 0):
            end = 0
            for raw in (raw_a, raw_b)[k]:
                at[k].append((end, end + len(raw)))
                end += len(raw)
        both = {y for _, y in at[0]} & {y for _, y in at[1]}
        sides = [[], []]
        for k in (0, 1):
            group = []
            for i, (_, y) in zip(ids[k], at[k]):
                group.append(i)
                if y in both:
                    sides[k].append(group)
                    group = []
        groups = list(zip(*sides))
        links, j = [], 0
        for i, (x, y) in enumerate(at[0]):
            while j and at[1][j - 1][1] > x:
                j -= 1
            while j < len(at[1]) and at[1][j][0] < y:
                if at[1][j][1] > x:
                    links.append((ids[0][i], ids[1][j]))
                j += 1
        held.update(set(links))
        out.append((ids, groups, links))
    highest = defaultdict(int)
    for (a, _), n in held.items():
        highest[a] = max(highest[a], n)
    rows = []
    for ids, groups, links in out:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        rows.append((
            len(ids[0]), len(ids[1]), len(groups), len(links), sum(held[p] == highest[p[0]] for p in links), sum(held[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return rows, out


def test_ends_align_as_sets_do():
    rnd = random.Random(7)
    for trial in range(300):
        n = rnd.choice([1, 2, 5, 40, 300])
        rate = rnd.choice([0.02, 0.3, 0.9])
        base = sorted(rnd.sample(range(1, 4 * n + 2), n))
        a, b = ([x for x in base if rnd.random() > rate] for _ in range(2))
        end = base[-1] + 1
        a, b = a + [end], b + [end]
        group_a, group_b, link_a, link_b = align.align_ends(np.array(a), np.array(b))
        both = sorted(set(a) & set(b))
        assert [a[i - 1] for i in group_a] == both == [b[j - 1] for j in group_b]
        span = lambda x: list(zip([0, *x], x))
        want = {(i, j) for i, (p, q) in enumerate(span(a)) for j, (r, s) in enumerate(span(b)) if p < s and r < q}
        assert set(zip(link_a.tolist(), link_b.tolist())) == want and len(link_a) == len(want)


def test_long_stretches_and_irregular_ends():
    ends = np.arange(1, 100_001)
    group_a, group_b, link_a, link_b = align.align_ends(ends, np.delete(ends, [7, 50_000, 99_998]))
    assert len(group_a) == 100_000 - 3 == len(group_b) and len(link_a) == 100_000 == len(set(zip(link_a, link_b)))


def test_parts_of_texts_have_the_ids_of_whole_texts():
    """White space of every kind around blanks, where the two could differ."""
    tok = align.Tokenizers(align.load(A, B))
    assert tok.by_part
    rnd = random.Random(11)
    pieces = [" ", " ", " ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "\u2028", "a", "the", "'s", "1", ".", "é", "\U0001f642", "\u200b"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 25))) for _ in range(4000)]
    x = align.Aligned(tok, texts)
    for k, t in enumerate(texts):
        a, b = tok.a.encode(" " + t, add_special_tokens=False).ids, tok.b.encode(t)
        got = [x.ids[w][x.offs[w][k]:x.offs[w][k + 1]].tolist() for w in (0, 1)]
        assert got in ([a, b], [[], []]), t
        raw = [b"".join(tok.raw[w][i] for i in ids) for w, ids in ((0, a), (1, b))]
        assert bool(got[0]) == (raw[0] == raw[1] == (" " + t).encode()), t


def test_tables_with_odd_rows_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(align, "BLOCK", 5000)  # several blocks a batch
    texts = ODD + TEXTS + [prose(60, s % 5) for s in range(30)] + TEXTS[:2]
    ids = [*range(len(texts) - 2), None, 0]
    docs = frame(spark, texts, ids).repartition(5)
    want, _ = brute(texts)
    got = align.report(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(((i, *w) for i, w in zip(ids, want)), key=order)
    assert align.report(docs.limit(0), A, B).collect() == []


def test_align_gives_ids_and_groups_and_keeps_columns(spark):
    docs = frame(spark, ODD + TEXTS)
    out = align.align(docs, A, B)
    assert out.columns == [*docs.columns, *align.RESULTS]
    _, want = brute(ODD + TEXTS)
    for r in out.collect():
        ids, groups, _ = want[r.doc_id]
        assert (r.a_ids, r.b_ids) == (list(ids[0]), list(ids[1]))
        at = [(sum(len(g[0]) for g in groups[:k + 1]), sum(len(g[1]) for g in groups[:k + 1])) for k in range(len(groups))]
        assert list(zip(r.group_a_ends, r.group_b_ends)) == at
    assert align.align(docs.limit(0), A, B).collect() == []
