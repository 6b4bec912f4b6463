"""Statistics of a chunk of texts, all rows at once, for the quality operators."""

from __future__ import annotations

import numpy as np

from faultline.llm import _text

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[ord("A"):ord("Z") + 1] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[ord("0"):ord("9") + 1] = True
MARK = np.zeros(256, dtype=bool)
MARK[list(b"!?;:(){}[]\"'`~^=+/\\_@")] = True
STOP = np.zeros(256, dtype=bool)
STOP[list(b".,")] = True


def repeated(key: np.ndarray) -> np.ndarray:
    """For each key how often it occurs."""
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[back]


def measure(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Counts for each row of a chunk (see ``_text.chunks``)."""
    n = len(offs) - 1
    start, end, row = _text.words(data, offs)
    prefix = _text.prefix_hash(data)
    seed = _text.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))

    def bytes_where(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[offs[1:]] - total[offs[:-1]]

    count = lambda mask, r=row: np.bincount(r[mask], minlength=n)
    out = {"words": np.bincount(row, minlength=n)}
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out["chars"] = points[offs[1:]] - points[offs[:-1]]
    length = points[end] - points[start]
    out["word_chars"] = _text.per_row(length, row, n).astype(np.int64)
    out["long_words"] = count(length > 20)
    out["symbols"] = bytes_where(SYMBOL[data])
    out["upper"] = bytes_where(UPPER[data])
    out["digits"] = bytes_where(DIGIT[data])
    out["marks"] = bytes_where(MARK[data])
    out["stops"] = bytes_where(STOP[data])

    own = seed[row]
    word = _text.span_hash(prefix, start, end)
    key = _text.mix(word ^ own)
    times = repeated(key)
    # a type that occurs k times gives 1/k for each occurrence
    out["types"] = np.rint(np.bincount(row, weights=1.0 / np.maximum(times, 1), minlength=n)).astype(np.int64)
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, row, times)
    out["top_word"] = most
    out["doubled"] = count(np.concatenate([[False], (word[1:] == word[:-1]) & (row[1:] == row[:-1])])) if len(word) else np.zeros(n, np.int64)

    # words in three-word windows that occur twice or more in their text
    if len(word) >= 3:
        whole = row[2:] == row[:-2]
        three = _text.mix(_text.mix(_text.mix(key[:-2]) + word[1:-1]) + word[2:])
        hit = np.zeros(len(three), dtype=bool)
        hit[whole] = repeated(three[whole]) > 1
        cover = np.zeros(len(word), dtype=bool)
        for k in range(3):
            cover[k:len(cover) - 2 + k] |= hit
        out["repeat_words"] = count(cover)
    else:
        out["repeat_words"] = np.zeros(n, np.int64)

    # lines with a word; a line is what stands between line feeds
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offs[:-1]] = True
    first[np.flatnonzero(data == 10) + 1] = True
    first[offs[-1]] = False
    line = np.flatnonzero(first)
    if len(line):
        owner = np.searchsorted(offs, line, "right") - 1
        stop = np.append(line[1:], len(data))
        feed = (stop > line) & (data[np.maximum(stop - 1, 0)] == 10)
        stop = stop - feed
        ink = np.concatenate([[0], np.cumsum(~_text.SPACE[data])])
        some = ink[stop] > ink[line]
        line, stop, owner = line[some], stop[some], owner[some]
        key = _text.mix(_text.span_hash(prefix, line, stop) ^ seed[owner])
        out["lines"] = np.bincount(owner, minlength=n)
        distinct = np.unique(key, return_index=True)[1]
        out["dup_lines"] = out["lines"] - np.bincount(owner[distinct], minlength=n)
    else:
        out["lines"] = out["dup_lines"] = np.zeros(n, np.int64)
    return out


FEATURES = ("log_words", "word_length", "long_words", "symbols", "upper", "digits", "marks", "stops", "types", "top_word", "doubled", "repeat_words", "dup_lines", "line_words")


def features(m: dict[str, np.ndarray]) -> np.ndarray:
    """Rows x FEATURES: logarithms of sizes, square roots of rates (which steadies
    the variance of counts); finite for every text, the empty one included."""
    words, chars = np.maximum(m["words"], 1), np.maximum(m["chars"], 1)
    rate = lambda k, by: np.sqrt(m[k] / by)
    return np.column_stack([
        np.log1p(m["words"]), np.log1p(m["word_chars"] / words), rate("long_words", words), rate("symbols", chars), rate("upper", chars), rate("digits", chars), rate("marks", chars), rate("stops", words),
        np.log(np.maximum(m["types"], 1) / words) / np.log(words + 1.0), rate("top_word", words), rate("doubled", words), rate("repeat_words", words), rate("dup_lines", np.maximum(m["lines"], 1)), np.log1p(words / np.maximum(m["lines"], 1)),
    ]).astype(np.float64)
