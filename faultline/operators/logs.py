"""Test logs and outcomes: log-line parsing, failing tests, tracebacks,
pass ratios and cumulative success by repair pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.session import spread


def parse_outcome_lines(log: DataFrame, value: str = "value") -> DataFrame:
    """SRC-16: ``container | project,bug,phase,status`` → typed columns.
    Lines without the four fields are dropped."""
    fields = F.split(T.py_strip(F.element_at(F.split(F.col(value), r"\|", -1), -1)), ",", -1)
    x = log.select(
        T.py_strip(F.split(F.col(value), r"\|", -1)[0]).alias("container"),
        fields.alias("_f"),
    )
    return x.where(F.size("_f") == 4).select(
        "container",
        F.trim(F.col("_f")[0]).alias("project"),
        F.trim(F.col("_f")[1]).alias("bug"),
        F.trim(F.col("_f")[2]).alias("phase"),
        F.trim(F.col("_f")[3]).alias("status"),
    )


def pass_ratio(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AGG-14: passes / (passes + fails), counted on parsed fields (Q20)."""
    st = F.col("status")
    return outcomes.groupBy(*by).agg(
        F.count_if(st == "pass").cast("bigint").alias("n_pass"),
        F.count_if(st == "fail").cast("bigint").alias("n_fail"),
        F.round(F.try_divide(F.count_if(st == "pass"), F.count_if(st.isin("pass", "fail"))), 6).alias("ratio"),
    )


def cumulative_success(outcomes: DataFrame, bug: Sequence[str], passes: int = 3, pass_no: str = "pass_no") -> DataFrame:
    """AGG-20: share of bugs solved by pass p (first passing pass <= p)."""
    first = outcomes.groupBy(*bug).agg(F.min(F.when(F.col("status") == "pass", F.col(pass_no))).alias("_first"))
    x = first.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(passes))))
    return x.groupBy("pass").agg(
        F.count_if(F.col("_first") <= F.col("pass")).cast("bigint").alias("solved"),
        F.count(F.lit(1)).cast("bigint").alias("bugs"),
        F.round(F.try_divide(F.count_if(F.col("_first") <= F.col("pass")), F.count(F.lit(1))), 6).alias("rate"),
    )


def failing_test_names(traces: DataFrame, key: Sequence[str], raw: str = "raw") -> DataFrame:
    """SCA-05 exploded: ``key + [pos, test]``."""
    return traces.select(*key, F.posexplode(T.failing_tests(F.col(raw))).alias("pos", "test"))


def tracebacks(traces: DataFrame, key: Sequence[str], raw: str = "raw") -> DataFrame:
    """SCA-06 + FLT-02: extracted trace per row, rows without one dropped."""
    # explode() of one element is a line that neither projections nor filters cross,
    # so the patterns run once a row
    x = traces.select(*key, F.col(raw).alias("_raw"), F.explode(F.array(T.pytest_sections(F.col(raw)))).alias("_secs"))
    y = x.select(*key, F.explode(F.array(T.extract_traceback(F.col("_raw"), F.col("_secs")))).alias("trace"))
    return y.where(F.coalesce(F.col("trace"), F.lit("")) != "")


# Frames that say nothing about the project: installed packages, the interpreter's own
# modules, generated code, logging.
UNINFORMATIVE_FRAME = r"(?:^|/)(?:site-packages|dist-packages|lib/python[0-9.]*|lib64/python[0-9.]*|logging)/|^<[^>]*>$|(?:^|/)logging\.py$"
FRAME = r'^(\s*)File "([^"]*)", line \d+'


def frames(traces: DataFrame, key: Sequence[str], trace: str = "trace") -> DataFrame:
    """FLT-08: the lines of each traceback with the frame they belong to:
    ``key + [pos, line, frame, path]``.

    A frame is a line ``File "path", line n`` and the lines below it that are
    indented further, its code; they get a number that a running sum gives and that
    ends at the first line that isn't (``frame`` and ``path`` are null there)."""
    key = list(key)
    x = spread(traces, key, text=trace).select(*key, F.posexplode(F.split(F.coalesce(F.col(trace), F.lit("")), "\n", -1)).alias("pos", "line"))
    indent = F.length(F.regexp_extract("line", r"^[ \t]*", 0))
    so_far = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"_head": F.regexp_like("line", F.lit(FRAME)), "_indent": indent})
    x = x.withColumn("frame", F.sum(F.col("_head").cast("int")).over(so_far))
    at = Window.partitionBy(*key, "frame").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({
        "_of": F.max(F.when(F.col("_head"), F.col("_indent"))).over(at),
        "_path": F.max(F.when(F.col("_head"), F.regexp_extract("line", FRAME, 2))).over(at),
    })
    out = F.coalesce(F.sum((~F.col("_head") & (F.col("_indent") <= F.col("_of"))).cast("int")).over(at), F.lit(0))
    inside = (F.col("frame") > 0) & (out == 0)
    return x.withColumn("_inside", inside).select(
        *key, "pos", "line", F.when(F.col("_inside"), F.col("frame")).cast("int").alias("frame"), F.when(F.col("_inside"), F.col("_path")).alias("path"))


def informative(traces: DataFrame, key: Sequence[str], trace: str = "trace", pattern: str = UNINFORMATIVE_FRAME) -> DataFrame:
    """FLT-08: ``key + [trace, n_frames, n_dropped]``: tracebacks without the frames
    whose path matches ``pattern``; a frame goes with its code lines, and all other
    lines stay.  A trace may lose every frame and keeps its message then."""
    key = list(key)
    x = frames(traces, key, trace).withColumn("_gone", F.coalesce(F.regexp_like("path", F.lit(pattern)), F.lit(False)))
    left = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_gone"), F.struct("pos", "line")))), lambda r: r["line"]), "\n")
    # sets of a trace's few frames; counts of distinct values would write every line three times
    count = lambda c: F.size(F.collect_set(c)).cast("bigint")
    return x.groupBy(*key).agg(left.alias("trace"), count("frame").alias("n_frames"), count(F.when(F.col("_gone"), F.col("frame"))).alias("n_dropped"))


def trace_lengths(traces: DataFrame, by: Sequence[str] = (), raw: str = "raw") -> DataFrame:
    """AGG-12: lines of the raw traces: shortest, longest, mean, and how many traces."""
    n = T.n_parts(F.col(raw))
    return traces.groupBy(*by).agg(F.min(n).alias("min_lines"), F.max(n).alias("max_lines"), F.round(F.avg(n), 6).alias("avg_lines"), F.count(n).cast("bigint").alias("n_traces"))
