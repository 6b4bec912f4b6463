"""What is derived from a table that packs well: no side of a join goes to the driver, and partitions grow with the rows."""

import pytest
from pyspark.sql import functions as F

from faultline.operators import lexer, logs, patches, source, spans
from faultline.session import parts, spread

DIFF = "diff --git a/m.py b/m.py\n--- a/m.py\n+++ b/m.py\n@@ -3,2 +3,2 @@\n a = 1\n-b = 2\n+b = 3"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def diffs(spark):
    return spark.range(40).select(F.col("id").alias("k"), F.lit(DIFF).alias("diff"))


def test_partitions_grow_with_rows(spark):
    assert parts(spark.range(1000), 10) == 100 and parts(spark.range(3), 10) <= 3
    out = spread(spark.range(1000), ["id"], 50)
    assert out.rdd.getNumPartitions() == 20 and out.count() == 1000
    few = spark.range(3).select("id", F.repeat(F.lit("x"), 1 << 22).alias("t"), F.lit(None).cast("string").alias("none"))
    assert spread(few, ["id"], text="t").rdd.getNumPartitions() == 8 and spread(few, ["id"], text="none").rdd.getNumPartitions() == 1


def test_numbers_of_lines_need_no_join(spark, diffs):
    out = patches.numbered_lines(diffs, ["k"])
    assert "Broadcast" not in plan(out) and "Join" not in plan(out)
    assert {tuple(r) for r in out.select("pos", "file", "code", "line_no").collect()} == {(5, "m.py", "b = 2", 4)} and out.count() == 40


def test_repeated_and_null_keys_keep_their_rows(spark):
    rows = spark.createDataFrame([(1, DIFF), (1, DIFF), (None, DIFF)], "k int, diff string")
    got = sorted(((r.k or 0), r.line_no) for r in patches.numbered_lines(rows, ["k"], fixed=True).collect())
    assert got[0] == (0, None) and [k for k, _ in got] == [0, 1, 1, 1, 1]


def test_lines_and_spans_never_go_to_the_driver(spark, diffs):
    text = "import os\ndef f(x):\n    return g(x)\n"
    files = diffs.select("k", F.lit("m.py").alias("file"), F.lit(text).alias("content"))
    at = ["k", "file"]
    ln, found = source.facts(files, at)
    lines = diffs.select("k", F.lit("m.py").alias("file"), F.lit(2).alias("line_no"), F.lit("def f(x):").alias("code"))
    for df in (source.chunks(ln, found, at), source.calls(ln, found, at), spans.locate(lines.drop("line_no"), files, at), spans.locate_at(lines, files, at),
               spans.enclosing(lines, found, at)):
        assert "Broadcast" not in plan(df)
    assert source.calls(ln, found, at).count() == 40


def test_frames_are_counted_without_repeating_lines(spark):
    trace = 'Traceback\n  File "/app/a.py", line 1, in f\n    x\n  File "/usr/lib/python3.11/logging/__init__.py", line 2, in g\n    y\nValueError'
    out = logs.informative(spark.createDataFrame([(1, trace), (2, None)], "k int, trace string"), ["k"])
    assert "Expand" not in plan(out)
    assert [(r.k, r.n_frames, r.n_dropped) for r in out.orderBy("k").collect()] == [(1, 2, 1), (2, 0, 0)]


def test_tasks_of_code_facts_hold_a_bounded_number_of_lines(spark, monkeypatch):
    """Files, lines and spans are dealt out so that a task's share doesn't grow with the table, in every step behind ``facts``."""
    monkeypatch.setattr("faultline.operators.source.LINES", 400)
    monkeypatch.setattr("faultline.session.PART_CHARS", 4000)
    text, at = "import os\ndef f(x):\n    return g(x)\n", ["k"]
    size = F.spark_partition_id()
    for n in (500, 2000):
        files = spark.range(n).select(F.col("id").alias("k"), F.lit(text).alias("content"))
        by_task = lambda df: df.groupBy(size.alias("p")).count().agg(F.max("count")).first()[0]
        # 36 characters and 4 lines a file
        assert by_task(lexer.states(files, at)) <= 2 * 4 * 4000 // 36
        ln, found = source.facts(files, at)
        assert by_task(source.by_file(ln, at)) <= 2 * 400
        assert parts(ln, source.LINES) >= 4 * n // 400 and ln.count() == 4 * n and found.count() == n
        wide = [df.rdd.getNumPartitions() for df in (source.calls(ln, found, at), source.masked(lexer.lines(files, at), at))]
        assert wide[0] >= 4 * n // 400 and wide[1] >= 36 * n // 4000
