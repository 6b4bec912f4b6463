"""Chunking: fixed-size character chunks and minimum-cost line segmentation.

Fixed chunks are one ``explode`` over ``sequence`` (JVM-side, no shuffle).
The segmentation DP is sequential inside a document, so it runs in an Arrow
batch (``mapInPandas``) with one document per row; documents are never
grouped together, and the breaks of a document are at most its line count.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_CHUNK = 2000
# Cost of a break at a definition line.
BREAK_COSTS = {"class": 3.0, "function": 5.0, "async_function": 5.0}


def query_text(strategy: Column, code: Column, symptom: Column, trace: Column) -> Column:
    """PRJ-02: ``code_only`` → code; ``error_info`` → symptom + ' ' + trace;
    otherwise symptom, trace and code joined by spaces (a null part gives null)."""
    return (
        F.when(strategy == "code_only", code)
        .when(strategy == "error_info", F.concat(symptom, F.lit(" "), trace))
        .otherwise(F.concat(symptom, F.lit(" "), trace, F.lit(" "), code))
    )


def fixed_chunks(df: DataFrame, key: Sequence[str], text: str, size: int = DEFAULT_CHUNK) -> DataFrame:
    """UDTF-02 + WIN-04: consecutive ``size``-character chunks, no overlap;
    an empty text gives no chunk.  Output ``key + [chunk_no, chunk]``."""
    t = F.col(text)
    starts = F.when(F.length(t) > 0, F.sequence(F.lit(0), F.length(t) - 1, F.lit(size))).otherwise(
        F.array().cast("array<int>")
    )
    x = df.select(*key, t.alias("_t"), F.posexplode(starts).alias("chunk_no", "_s"))
    return x.select(*key, F.col("chunk_no").cast("int"), F.substring(F.col("_t"), F.col("_s") + 1, size).alias("chunk"))


def min_cost_split(n: int, costs: dict[int, float], window: int, general: float):
    """UDTF-03 DP: dp[i] = cost(i) + min(dp[j]) for j in [i-window, i);
    ties take the smallest j.  Returns inclusive 0-based ranges and the total.

    ``cost(i)`` does not depend on j, so the inner minimum is a sliding-window
    minimum (monotone deque): O(n) instead of O(n * window).
    """
    best = [0.0]
    begins = [0]  # where the last range of the best split of the first i lines begins
    low: deque[int] = deque()
    for i in range(1, n + 1):
        while low and best[low[-1]] > best[i - 1]:
            low.pop()
        low.append(i - 1)
        if low[0] < i - window:
            low.popleft()
        begins.append(low[0])
        best.append(best[low[0]] + costs.get(i, general))
    ends = [n] if n > 0 else []
    while ends and begins[ends[-1]]:
        ends.append(begins[ends[-1]])
    return [(begins[e], e - 1) for e in reversed(ends)], best[-1]


def min_cost_segments(
    docs: DataFrame,
    breaks: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    window: int = 20,
    general_cost: float = 10.0,
    order: str | None = None,
) -> DataFrame:
    """UDTF-03 over a table: ``docs(id, text)`` and ``breaks(id, line_no, cost)``
    (``line_no`` is the DP index i: a chunk ending with 1-based line i; of several
    breaks at one line the last by the column ``order`` counts, else the dearest).
    Chunk text is the ``\\n``-joined lines, stripped; ``n_chars`` is its length.
    Output: ``id, seg_no, start_line, end_line, n_chars, total_cost``."""
    window = int(window)
    cost = F.col("cost").cast("double")
    one = breaks.groupBy(F.col(id_col).alias("_id"), F.col("line_no").cast("int").alias("_l")).agg((F.max_by(cost, order) if order else F.max(cost)).alias("_c"))
    b = one.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("_l", "_c"))).alias("_costs"))
    j = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t")).join(b, "_id", "left")
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("seg_no", T.IntegerType()), T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()), T.StructField("n_chars", T.LongType()), T.StructField("total_cost", T.DoubleType()),
    ])

    def run(batches):
        for pdf in batches:
            rows = []
            for key, txt, costs in zip(pdf["_id"], pdf["_t"], pdf["_costs"]):
                lines = (txt or "").split("\n")
                ranges, total = min_cost_split(len(lines), dict(costs) if costs is not None else {}, window, general_cost)
                rows += [(key, no, a, b, len("\n".join(lines[a:b + 1]).strip()), float(total)) for no, (a, b) in enumerate(ranges)]
            yield pd.DataFrame(rows, columns=schema.names)

    return j.mapInPandas(run, schema)


def break_costs(spans: DataFrame, key: Sequence[str], code: str = "code", costs: dict[str, float] | None = None) -> DataFrame:
    """UDTF-04: ``key + [line_no, cost]`` of definition lines, from spans with their
    source: a class or function costs less to break at; those that hold a lambda
    are left out, and of several on one line the later one (the inner) counts."""
    values = costs or BREAK_COSTS
    cost = F.coalesce(*[F.when(F.col("kind") == k, F.lit(float(v))) for k, v in values.items()])
    own = spans.where(cost.isNotNull() & ~F.contains(F.col(code), F.lit("lambda")))
    return own.groupBy(*key, F.col("start_line").alias("line_no")).agg(F.max_by(cost, "seq").alias("cost"))
