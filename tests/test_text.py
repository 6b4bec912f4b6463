from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.operators import logs, patches


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


def test_kv_last_wins_and_second_equals(spark):
    df = spark.createDataFrame([('github_url="https://h/x"\nq="x=y"\nq="z"',)], "info string")
    kv = df.select(F.explode(T.parse_kv(F.col("info"))).alias("kv")).select("kv.*")
    out = {r.key: r.value for r in kv.groupBy("key").agg(F.max_by("value", "pos").alias("value")).collect()}
    assert out == {"github_url": "https://h/x", "q": "z"}
    one = spark.createDataFrame([('q="x=y"',)], "info string").select(F.explode(T.parse_kv(F.col("info"))).alias("kv"))
    assert one.first().kv.value == "x"


def test_decorations(spark):
    txt = "_____ test_a _____\n\nE  x\n-----\n----\na ===== b\n=====  done"
    out = _one(spark, T.remove_decorations, txt)
    assert out == "\nE  x\n----\na ===== b\n=====  done"


def test_failing_tests(spark):
    out = _one(spark, T.failing_tests, "FAIL: test_a (m.T)\nERROR: test_b\nFAIL: test_a")
    assert out == ["test_a", "test_b", "test_a"]


def test_traceback_pytest(spark):
    raw = ("===== FAILURES =====\n_____ test_a _____\nE  boom\n"
           "---------- Captured stdout ----------\nhi")
    assert _one(spark, lambda c: T.extract_traceback(c, T.pytest_sections(c)), raw) == "E  boom"


def test_traceback_unittest(spark):
    raw = ("FAIL: test_x (m.T)\n" + "-" * 10 + "\nTraceback\nE: z\n\n" + "-" * 22 + "\nRan 1")
    assert _one(spark, lambda c: T.extract_traceback(c, T.pytest_sections(c)), raw) == "FAIL: FAIL: test_x (m.T)\n----------\nTraceback\nE: z"


def test_traceback_none(spark):
    assert _one(spark, lambda c: T.extract_traceback(c, T.pytest_sections(c)), "all good") is None


def test_diff_path_greedy(spark):
    df = spark.createDataFrame([(1, "diff --git a/x b/y.py b/x b/y.py\n")], "id int, diff string")
    assert [r.path for r in patches.changed_paths(df, ["id"]).collect()] == ["y.py"]
    js = spark.createDataFrame([(1, '["a.py", "b.py"]')], "id int, diff string")
    assert [r.path for r in patches.changed_paths(js, ["id"]).orderBy("pos").collect()] == ["a.py", "b.py"]


def test_hunk_functions(spark):
    d = "@@ -1 +1 @@ def foo(a):\n x\n@@ -5 +5 @@ class K:\n@@ -9 +9 @@ def bar():\n"
    df = spark.createDataFrame([(1, d)], "id int, diff string")
    assert patches.hunk_functions(df, ["id"]).first().functions == ["bar", "foo"]


def test_changed_lines_two_files(spark):
    d = "\n".join([
        "diff --git a/m.py b/m.py", "--- a/m.py", "+++ b/m.py", "@@ -1,2 +1,2 @@", "-old1", "-old2", "+new",
        "diff --git a/n.py b/n.py", "--- a/n.py", "+++ b/n.py", "@@ -3 +3 @@", "-old3", "---skip", "+new3",
    ])
    df = spark.createDataFrame([(1, d)], "id int, diff string")
    got = [(r.file, r.code) for r in patches.changed_lines(df, ["id"]).orderBy("pos").collect()]
    assert got == [("m.py", "old1"), ("m.py", "old2"), ("n.py", "old3")]
    fixed = [(r.file, r.code) for r in patches.changed_lines(df, ["id"], fixed=True).orderBy("pos").collect()]
    assert fixed == [("m.py", "new"), ("n.py", "new3")]


def test_pass_ratio(spark):
    lines = ["c | p,%d,1,pass" % i for i in range(26)] + ["c | p,%d,1,fail" % i for i in range(10)]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    r = logs.pass_ratio(logs.parse_outcome_lines(df)).first()
    assert (r.n_pass, r.n_fail, r.ratio) == (26, 10, 0.722222)
