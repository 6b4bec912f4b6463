"""Documents with every awkward case, and plain Python counterparts of the operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double, ids string, n_tokens string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def frame(spark, texts, ids=None, extra="x"):
    """A documents table with extra columns whose names clash with results."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or ""), extra, 1.0, extra, extra) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(n, seed, words=400):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice(["the", "an", "er", "in", "ou", "sh", "é", "ü"]) for _ in range(rnd.randint(1, 3))) for _ in range(words)]
    return " ".join(rnd.choice(vocabulary) for _ in range(n))


ODD = [None, "", "   \n\t ", "One", "two words", "a " * 30000 + "END", "naïve 日本語 🙂 ﬁ\u0000", "x" * 5000]
