"""Scores of the suffix tree against a plain reading of its definition."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from faultline.llm import lm
from tests.llm.helpers import ODD, WORD, frame, lower, prose


def stream(text):
    return list(" ".join(WORD.findall(lower(text or ""))).encode()) + [lm.END]


def char_model(texts):
    """log10 probability of each symbol of a text, from dictionaries of what follows each context."""
    follow = defaultdict(Counter)
    for t in texts:
        s = [lm.END, *stream(t)]
        for i in range(1, len(s)):
            for k in range(min(lm.DEPTH, i) + 1):
                follow[tuple(s[i - k:i])][s[i]] += 1
    root = np.array([follow[()][c] for c in range(lm.SYMBOLS)], dtype=float)
    least = max(lm.SUPPORT * root.sum(), 1)
    dist, states = {(): (root + 1) / (root.sum() + lm.SYMBOLS)}, {()}
    for k in range(1, lm.DEPTH + 1):
        for c in [c for c in follow if len(c) == k]:
            # how often the context itself occurs, as the last symbol behind the rest
            if c[:-1] in dist and follow[c[:-1]][c[-1]] >= least and (k == 1 or c[-1] != lm.END) and c[1:] in dist:
                n = np.array([follow[c][x] for x in range(lm.SYMBOLS)], dtype=float)
                dist[c] = (n + lm.WEIGHT * dist[c[1:]]) / (n.sum() + lm.WEIGHT)
                if (dist[c] * np.log(dist[c] / dist[c[1:]])).sum() >= lm.DIVERGENCE:
                    states |= {c[j:] for j in range(k + 1)}

    def logs(text):
        s = [lm.END, *stream(text)]
        out = []
        for i in range(1, len(s)):
            c = max((tuple(s[i - k:i]) for k in range(min(lm.DEPTH, i) + 1) if tuple(s[i - k:i]) in states), key=len)
            out.append(math.log10(dist[c][s[i]]))
        return out

    return logs


def plain_scores(rows, common_share):
    """Score of each row (id, text)."""
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    logs = char_model([t for (_, t), ok in zip(rows, train) if ok])
    words = [WORD.findall(lower(t or "")) for _, t in rows]
    total = Counter(w for ws, ok in zip(words, train) if ok for w in [*ws, None])
    least = max(1, math.ceil(common_share * sum(total.values())))
    follows, of = defaultdict(list), []
    for r, ws in enumerate(words):
        per, at = logs(rows[r][1]), 0
        events = []
        for i, w in enumerate(ws):
            n = len(w.encode()) + 1
            events.append(((w, i == len(ws) - 1), 10 ** sum(per[at:at + n])))
            at += n
        of.append((sum(per), events))
        for i in range(1, len(ws)):
            for c in ((ws[i - 1],), (ws[i - 2] if i > 1 else None, ws[i - 1])):
                follows[c].append((events[i][0], events[i][1], rows[r], train[r]))

    def level(c, symbol, below, row, suffix):
        """(probability, retained); ``suffix`` gives the mean probability of a symbol in the suffix."""
        here = follows[c]
        n, pair = (sum(ok for s, _, _, ok in here if s == symbol or not only) for only in (False, True))
        others = [(s, k) for s, _, k, ok in here if ok and k != row]
        p = (sum(s == symbol for s, _ in others) + lm.WEIGHT * below) / (len(others) + lm.WEIGHT)
        count = Counter(s for s, _, _, ok in here if ok)
        mean = {s: suffix(s) for s in count}
        apart = sum((k + lm.WEIGHT * mean[s]) / (n + lm.WEIGHT) * math.log((k + lm.WEIGHT * mean[s]) / (n + lm.WEIGHT) / mean[s]) for s, k in count.items())
        left = lm.WEIGHT / (n + lm.WEIGHT)
        apart += max(1 - sum(mean.values()), 0) * left * math.log(left)
        return p, n > 0 and apart >= lm.DIVERGENCE

    mean = lambda xs: sum(xs) / len(xs)
    out = []
    for r, ws in enumerate(words):
        score, events = of[r]
        for i in range(1, len(ws)):
            if total[ws[i - 1]] >= least:
                continue
            one, two = (ws[i - 1],), (ws[i - 2] if i > 1 else None, ws[i - 1])
            symbol, base = events[i]
            p1, keep1 = level(one, symbol, base, rows[r], lambda s: mean([b for e, b, _, _ in follows[one] if e == s]))
            below = lambda e, b, k: level(one, e, b, k, lambda s: 1.0)[0]
            p2, keep2 = level(two, symbol, p1, rows[r], lambda s: mean([below(e, b, k) for e, b, k, _ in follows[two] if e == s]))
            score += math.log10((p2 if keep2 else p1 if keep1 else base) / base)
        out.append(score)
    return train, out


@pytest.mark.parametrize("share", [1e-5, 0.02])
def test_scores_equal_a_plain_reading(spark, monkeypatch, share):
    monkeypatch.setattr(lm, "COMMON", share)
    texts = [t for t in ODD if not t or len(t) < 100] + [prose(25, s % 9, 40) for s in range(30)] + ["x", "x y", " z  x y\n"]
    rows = list(enumerate(texts))
    rows += [rows[9], rows[9]]  # identical rows
    train, want = plain_scores(rows, share)
    got = {r.doc_id: r.score for r in lm.score(frame(spark, [t for _, t in rows], [i for i, _ in rows])).collect()}
    for (i, t), s in zip(rows, want):
        assert got[i] == pytest.approx(s, rel=1e-4, abs=1e-3), (i, t)


def test_what_another_text_holds_raises_a_score(spark, monkeypatch):
    """A copy lifts a text far above a text of the same kind, whichever of the two is held out."""
    monkeypatch.setattr(lm, "COMMON", 0.02)
    texts = [prose(60, s, 3000) for s in range(40)]
    copies = texts[:10]
    docs = frame(spark, texts + copies)
    got = {r.doc_id: r.score / r.n_tokens for r in lm.score(docs).collect()}
    train = {i for i in got if zlib.crc32(str(i).encode()) % 7 != 2}
    lifted = [got[k] for k in range(10) if k + 40 in train] + [got[k + 40] for k in range(10) if k in train]
    alone = [got[k] for k in range(10, 40)]
    assert len(lifted) >= 10 and min(lifted) > max(alone) + 0.5


@pytest.mark.parametrize("hot", [1 << 20, 25, 3])
def test_every_word_is_a_context(spark, monkeypatch, hot):
    """Common words too, whether in one bucket or dealt out to several."""
    monkeypatch.setattr(lm, "HOT", hot)
    monkeypatch.setattr(lm, "SLICE", 40)
    texts = [t for t in ODD if not t or len(t) < 100] + [prose(25, s % 9, 40) for s in range(30)] + ["x", "x y", " z  x y\n", "x y x y x y x x"]
    rows = list(enumerate(texts))
    rows += [rows[9], rows[9], rows[-1]]  # identical rows
    train, want = plain_scores(rows, 10)
    got = {r.doc_id: r.score for r in lm.score(frame(spark, [t for _, t in rows], [i for i, _ in rows]), every=True).collect()}
    for (i, t), s in zip(rows, want):
        assert got[i] == pytest.approx(s, rel=1e-4, abs=1e-3), (i, t)


def test_the_query_leaves_no_word_out(monkeypatch):
    from faultline.llm import queries

    monkeypatch.setattr(queries, "read_table", lambda *a: None)
    monkeypatch.setattr(queries, "small_batches", lambda s: None)
    monkeypatch.setattr(lm, "score", lambda docs, **options: options)
    assert queries.op7_lm(None, "") == {"every": True}
