"""Byte-level helpers shared by the operators: whole Arrow batches of texts as
numpy arrays, word boundaries, and 64-bit hashes of arbitrary spans.

A batch is walked in chunks of about ``CHUNK`` bytes of text, so memory stays
bounded whatever the batch holds; a document longer than that is a chunk of
its own and is still processed whole.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

CHUNK = 1 << 19

_LIBC = ctypes.CDLL(None)
# What an operator keeps in its Python worker from task to task; the next one to use the worker drops it.
KEPT: dict = {}

# Words are runs of bytes outside \x20 and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit integers (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_BASE_INV = pow(_BASE, -1, 1 << 64)
LONG = 512  # bytes from which a span is hashed by itself
_tables = tuple(np.ones(1, dtype=np.uint64) for _ in range(2))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    global _tables
    if len(_tables[0]) < n:
        n = max(1 << (n - 1).bit_length(), 2 * CHUNK)
        out = []
        for base in (_BASE, _BASE_INV):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        _tables = tuple(out)
    return _tables


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash modulo 2^64, and the bytes; see ``span_hash``."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * _powers(len(data) + 1)[0][:len(data)], out=out[1:])
    return out, data


def span_hash(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes [start, end), the same wherever they stand.

    Modulo a power of two there are words, of some thousand letters, that are equal for every
    base (a Thue-Morse word and its complement), so spans of LONG bytes or more are read
    one by one with another hash; short ones, which are many, take one subtraction each."""
    sums, data = prefix
    out = mix((sums[end] - sums[start]) * _powers(len(sums))[1][start])
    long = np.flatnonzero(end - start >= LONG)
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        out[long] = np.array([xxh3_64_intdigest(view[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist())], dtype=np.uint64)
    return out


def tidy() -> None:
    """Give freed memory back to the system: Python workers are reused, and what one
    stage has kept would count beside what the next one needs."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (bytes, offsets); a null is an empty text."""
    a = batch.column(batch.schema.get_field_index(name))
    if a.null_count:
        a = pc.fill_null(a, "")
    kind = np.int64 if pa.types.is_large_string(a.type) else np.int32
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(a.buffers()[1], dtype=kind)[a.offset:a.offset + len(a) + 1].astype(np.int64)
    raw = a.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def chunks(batch: pa.RecordBatch, name: str, size: int = CHUNK, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of at most ``rows`` rows."""
    KEPT.clear()
    data, offs = column(batch, name)
    a, n = 0, len(offs) - 1
    while a < n:
        b = min(n, a + rows, max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1))
        yield a, b, data[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
        a = b
    tidy()


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; a word never crosses rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~SPACE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True
    begin = ink.copy()
    begin[1:] &= ~ink[:-1] | first[1:n]
    stop = ink.copy()
    stop[:-1] &= ~ink[1:] | first[1:n]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(stop) + 1, np.searchsorted(offs, start, "right") - 1


def pick(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def per_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` for each of ``n`` rows."""
    return np.bincount(row, weights=values, minlength=n)
