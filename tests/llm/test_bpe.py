import hashlib
import random

import pytest

from faultline.llm import bpe
from tests.llm.helpers import ODD, frame, prose

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


TEXTS = [
    "<|endoftext|>a<|startoftext|> b<|endoftext|>", "<|ENDOFTEXT|> <|endoftext", "ΑΣ ΣΑΣ Σ", "İstanbul ǅ ẞ", "é Å x y\x1cz\x85q\ufeff",
    "it's we'll I'D 'S ''re x'", "日本語テキスト 🙂👩‍👩‍👧 ½ ² Ⅷ 123", "한국어 각 ­​", "\x00\x01 \r\n\u2028\u3000x", "a" * 3000 + "b" * 37,
]


def test_same_ids_and_text_as_the_library(reference):
    rnd = random.Random(3)
    texts = TEXTS + [t for t in ODD if t] + ["".join(rnd.choice("ainthoer'<|>é日 .,!0") for _ in range(rnd.randint(1, 200))) for _ in range(300)]
    enc = bpe.Encoder(bpe.load(PATH))
    for text, ids in zip(texts, enc.encode(texts)):
        assert ids == reference.encode(text, add_special_tokens=False).ids, text[:50]


def test_tree_finds_the_leftmost_lowest_pair_and_both_merges_agree():
    tree = bpe.PairTree([5, 2, 9, 2, 7])
    assert tree.lowest() == 1
    tree.set(1, bpe.NO_PAIR)
    assert tree.lowest() == 3
    for i in (3, 0, 2, 4):
        tree.set(i, bpe.NO_PAIR)
    assert tree.lowest() == -1
    enc = bpe.Encoder(bpe.load(PATH))
    words = [w for w in prose(300, 5).split()] + ["a", "ab" * 40, "the"]
    symbols = [enc.symbols(w) for w in words]
    assert bpe.merge_all(symbols, *enc.table) == [bpe.merge(s, enc.ranks, enc.made) for s in symbols]


def test_small_memo_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 5)
    enc = bpe.Encoder(bpe.load(PATH))
    for _ in range(4):
        texts = [prose(50, s) for s in range(6)]
        assert enc.encode(texts) == [reference.encode(t, add_special_tokens=False).ids for t in texts]


def test_tables_with_odd_rows(spark, reference):
    texts = ODD + TEXTS + TEXTS[:2]
    ids = [*range(len(texts) - 2), None, 0]
    docs = frame(spark, texts, ids)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in zip(ids, texts):
        x = reference.encode(t or "", add_special_tokens=False)
        want.append((i, len(x.ids), digest(" ".join(map(str, x.ids))), digest(reference.decode(x.ids, skip_special_tokens=False))))
    got = [tuple(r) for r in bpe.digest(docs, PATH).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=order) == sorted(want, key=order)
    out = bpe.encode(docs, PATH)
    assert out.columns == [*[c for c in docs.columns if c != "ids"], "ids"] and out.count() == len(texts)
    assert bpe.digest(docs.limit(0), PATH).collect() == []


def test_decode_takes_nulls_and_unknown_ids(spark):
    df = spark.createDataFrame([(1, [320, None, 10**6, -1]), (2, None), (3, [])], "i int, ids array<int>")
    got = {r.i: r.decoded for r in bpe.decode(df, PATH).collect()}
    assert got[1] == "a</w>" and got[2] == "" and got[3] == ""
