"""A one-hash filter of long values: a bitmap of fixed size, so it can be
broadcast whatever the corpus.  False hits only let through what a later join
drops; a filter that has filled up lets everything through."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import _text

BITS = 1 << 26  # 8 MB


def _at(values: np.ndarray) -> np.ndarray:
    return (_text.mix(values.view(np.uint64)) % np.uint64(BITS)).astype(np.int64)


def bitmap(df: DataFrame, col: str) -> np.ndarray:
    """The bits of all values of a long column, united from the bytes that each partition sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, dtype=bool)
        for b in batches:
            bits[_at(b.column(0).to_numpy())] = True
        packed = np.packbits(bits)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at].astype(np.int32))], names=["at", "byte"])

    out = np.zeros(BITS // 8, dtype=np.uint8)
    found = df.select(col).mapInArrow(run, "at long, byte int").groupBy("at").agg(F.bit_or("byte").alias("byte")).toArrow()
    out[found.column("at").to_numpy()] = found.column("byte").to_numpy()
    return out


def holds(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = _at(values)
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)
