import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import graph, logs, patches, positions, report, spans
from faultline.sources import files, runs


def test_first_entry_that_ends_in_the_name_counts(spark):
    rows = [
        (1, 2, "b.f", ["b.g", "c.h"]), (1, 1, "a.f", ["a.h"]), (1, 3, "f", ["x.y"]), (1, 4, "a.g", []), (1, 0, "a.xf", ["q.r"]), (2, 9, "z.f", ["z.f", "w"]),
    ]
    g = spark.createDataFrame(rows, "k int, ord int, caller string, callees array<string>")
    got = sorted((r.k, r.name, r.callee) for r in graph.named_callees(g, ["k"]).collect())
    assert got == [(1, "f", "h"), (1, "xf", "r"), (2, "f", "f"), (2, "f", "w")]
    assert graph.named_callees(g.limit(0), ["k"]).collect() == []


def test_call_edges_name_every_kind_of_end(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    calls = t([(1, "a.py", "f", c) for c in ("g", "h", "i", "j", "len2")], "k int, path string, caller string, callee string")
    defined = t([(1, "a.py", "f"), (1, "a.py", "g"), (1, "m.py", "h"), (2, "m.py", "i")], "k int, path string, name string")
    imports = t([(1, "a.py", "h", "m.h"), (1, "a.py", "i", "m.i"), (1, "a.py", "j", "no.j")], "k int, path string, alias string, target string")
    tree = t([(1, "a.py"), (1, "m.py")], "k int, path string")
    got = {r.callee: (tuple(r.dst) if r.dst else None, r.cost, r.status) for r in graph.call_edges(calls, defined, imports, tree, ["k"]).collect()}
    assert got == {"g": (("a.py", "g"), 0, None), "h": (("m.py", "h"), 1, None), "i": (None, 1, "no_function"), "j": (None, 1, "no_module"), "len2": (None, 1, "external")}


def test_irrelevant_nodes_are_not_expanded(spark):
    e = spark.createDataFrame([("r", "a", 0), ("a", "b", 0), ("r", "x", 0), ("x", "b", 1), ("b", "c", 1)], "src string, dst string, cost int")
    roots = spark.createDataFrame([("r", "r")], "root string, node string")
    scores = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", 0.9), ("x", 0.5), ("r", None)], "node string, score double")
    kept = graph.most_relevant(scores, 3)
    assert {r.node for r in kept.collect()} == {"b", "c", "x"}
    got = {(r.node, r.depth) for r in graph.reachability(e, roots, relevant=kept).collect()}
    assert got == {("r", 0), ("x", 0), ("b", 1), ("c", 2)}
    assert {r.node for r in graph.reachability(e, roots, relevant=kept.limit(0)).collect()} == {"r"}


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_positions_are_a_global_order(spark, partitions):
    rnd = random.Random(partitions)
    keys = rnd.sample(range(1000), 37)
    df = spark.createDataFrame([(k, f"t{k}") for k in keys], "k int, t string").repartition(5)
    got = {r.k: r.position for r in positions.numbered(df, ["k"], partitions).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    assert positions.numbered(df.limit(0), ["k"], partitions).collect() == []


def test_sides_of_different_length_are_an_error(spark):
    a = spark.range(5).select(F.col("id").alias("a"))
    b = spark.range(5).select((-F.col("id")).alias("b"))
    assert sorted((r.a, r.b) for r in positions.zipped(a, b, ["a"], ["b"]).collect()) == [(i, i - 4) for i in range(5)]
    with pytest.raises(ValueError, match="5 rows can't be joined with 4"):
        positions.zipped(a, b.limit(4), ["a"], ["b"])


DIFF = """diff --git a/f.py b/f.py
--- a/f.py
+++ b/f.py
@@ -2,4 +2,4 @@ def x
 two

-four
+vier
+fuenf
 five
@@ -10 +11,2 @@
-ten
+zehn
diff --git a/g.py b/g.py
--- a/g.py
+++ b/g.py
@@ bad @@
-lost"""


def test_lines_numbered_by_hunks(spark):
    df = spark.createDataFrame([(1, DIFF)], "k int, diff string")
    assert [(r.file, r.code, r.line_no) for r in patches.numbered_lines(df, ["k"]).orderBy("pos").collect()] == [("f.py", "four", 4), ("f.py", "ten", 10), ("g.py", "lost", None)]
    assert [(r.code, r.line_no) for r in patches.numbered_lines(df, ["k"], fixed=True).orderBy("pos").collect()] == [("vier", 4), ("fuenf", 5), ("zehn", 11)]
    old = spark.createDataFrame([(1, "f.py", "a\ntwo\n\nfour\nfive")], "k int, file string, content string")
    got = spans.locate_at(patches.numbered_lines(df, ["k"]), old, ["k", "file"]).orderBy("pos").collect()
    assert [r.status for r in got] == ["found", "not_found", "no_file"]


TRACES = {
    # a frame's code may take several lines; what follows it stays
    '  File "/v/site-packages/a.py", line 1, in f\n    x(\n      y)\nValueError: z': ("ValueError: z", 1, 1),
    'T:\n  File "app.py", line 1\n    x\n  File "/usr/lib/python3.9/logging/__init__.py", line 2\n  File "b.py", line 3\nE': ('T:\n  File "app.py", line 1\n    x\n  File "b.py", line 3\nE', 3, 1),
    'no frames\n    at all': ('no frames\n    at all', 0, 0),
    'T:\n  File "<frozen x>", line 1\n\n  File "my_logging.py", line 1\nlog File "/x/logging/y.py", line 2': ('T:\n\n  File "my_logging.py", line 1\nlog File "/x/logging/y.py", line 2', 2, 1),
    "": ("", 0, 0),
}


def test_uninformative_frames_go_whole(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*TRACES, None])], "k int, trace string")
    got = {r.k: (r.trace, r.n_frames, r.n_dropped) for r in logs.informative(df, ["k"]).collect()}
    assert got == dict(enumerate([*TRACES.values(), ("", 0, 0)]))


def test_runs_are_read_when_they_are_complete(spark, tmp_path):
    root = str(tmp_path / "runs")
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "a int")
    assert runs.latest(spark, root, "a int").collect() == [] and runs.complete(spark, root) is None
    runs.publish(rows(1, 2), root, "12_31_2023__23_59_59")
    runs.publish(rows(3), root, "01_05_2024__10_00_00")
    runs.write_rows(rows(4), root, "02_05_2024__10_00_00")
    got = runs.latest(spark, root, "a int")
    assert [tuple(r) for r in got.collect()] == [(3, "01_05_2024__10_00_00")]
    assert "PartitionFilters: [isnotnull(run" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.a for r in runs.latest(spark, root, "a int", before="01_05_2024__10_00_00").collect()) == [1, 2]
    assert sorted((r.run, r.rows) for r in runs.complete(spark, root).collect()) == [("01_05_2024__10_00_00", 1), ("12_31_2023__23_59_59", 2)]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        runs.publish(rows(5), root, "12_31_2023__23_59_59")
    runs.publish(rows().limit(0), root, "03_05_2024__10_00_00")
    assert runs.latest(spark, root, "a int").collect() == []


def test_records_that_do_not_fit_are_set_apart(spark, tmp_path):
    folder = tmp_path / "x" / "project=p" / "bug=3"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text('{"a": 1, "b": "x"}\n\n{"a": "no number"}\n{"a": 2\nnot json\n{"b": "y", "c": 0}\n')
    good, bad = files.read_checked(spark, str(tmp_path / "x"), "a int, b string")
    assert sorted(map(tuple, good.collect()), key=str) == [("p", 3, 1, "x"), ("p", 3, None, "y")]
    assert sorted(r.record for r in bad.collect()) == ["not json", '{"a": "no number"}', '{"a": 2']
    assert all(r.path.endswith("a.json") for r in bad.collect())


def test_documents_of_several_lines_and_whole_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1,\n "b": "x"}\n')
    (tmp_path / "b.json").write_text('{"a": 2,\n')
    good, bad = files.read_checked(spark, str(tmp_path), "a int, b string", multi_line=True)
    assert [tuple(r) for r in good.collect()] == [(1, "x")] and [r.record for r in bad.collect()] == ['{"a": 2,\n']
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "c.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "deep" / "d.py").write_bytes(b"\xff\xfe")
    for binary in (False, True):
        got = {r.path.rsplit("/", 1)[1]: r.content for r in files.read_tree(spark, str(tmp_path), binary=binary).collect()}
        assert got["c.py"] == "x = 1\ny = 2\n" and ("d.py" in got) != binary


def test_vectors_come_back_or_are_set_apart(spark, tmp_path):
    rows = [(1, [1.0, 2.0], 0), (2, None, 0), (3, [1.0], 1), (4, [float("nan"), 1.0], 1), (5, [1.0, None], 1), (6, [float("-inf"), 0.0], 0), (7, [0.5, 0.25], None)]
    df = spark.createDataFrame(rows, "i int, embedding array<double>, label int")
    report.write_vectors(df, str(tmp_path / "v"), "i", partition_by=["label"])
    good, bad = files.read_vectors(spark, str(tmp_path / "v"), dim=2)
    assert sorted(r.i for r in good.collect()) == [1, 7] and sorted(r.i for r in bad.collect()) == [2, 3, 4, 5, 6]
    assert {r.i for r in files.read_vectors(spark, str(tmp_path / "v"))[0].collect()} == {1, 3, 7}
