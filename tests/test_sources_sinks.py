import json
import os
import re
import tempfile

from pyspark.sql import functions as F

from faultline.operators import report, source
from faultline.sources import files as S


def _tree():
    root = tempfile.mkdtemp(prefix="faultline-tree-")
    os.makedirs(os.path.join(root, "pkg", ".hidden"))
    with open(os.path.join(root, "pkg", "a.py"), "w") as f:
        f.write("def a():\n    return b()\n")
    with open(os.path.join(root, "pkg", ".hidden", "h.py"), "w") as f:
        f.write("x = 1\n")
    with open(os.path.join(root, "pkg", "notes.txt"), "w") as f:
        f.write("no")
    with open(os.path.join(root, "bad.py"), "wb") as f:
        f.write(b"\xff\xfe not utf8")
    return root


def test_read_tree_and_filters(spark):
    root = _tree()
    df = S.read_tree(spark, root, "*.py", binary=True)
    rel = df.select(S.relative_path(F.col("path"), root).alias("p"), "content")
    paths = sorted(r.p for r in rel.collect())
    # the undecodable file is dropped, the .txt file is not matched, and the
    # file listing itself skips hidden directories
    assert paths == ["pkg/a.py"]
    listed = spark.createDataFrame([("pkg/.hidden/h.py",), ("pkg/a.py",)], "p string")
    assert [r.p for r in listed.where(S.is_visible(F.col("p"))).collect()] == ["pkg/a.py"]
    ln = source.lines(rel.withColumnRenamed("p", "path"), ["path"])
    calls = {(r.path, r.caller, r.callee) for r in source.calls(ln, source.spans(ln, ["path"]), ["path"]).collect()}
    assert calls == {("pkg/a.py", "a", "b")}


def test_language_and_ignore_rules(spark):
    df = spark.createDataFrame([("src/m.py",), ("src/m.cc",), ("docs/x.md",), ("build/out.py",), ("keep/build/z.py",)],
                               "p string")
    assert sorted(r.p for r in df.where(S.has_language(F.col("p"), "python")).collect()) == [
        "build/out.py", "keep/build/z.py", "src/m.py"]
    assert [r.p for r in df.where(S.has_language(F.col("p"), "c++")).collect()] == ["src/m.cc"]
    rules = S.compile_rules(["# comment", "build/", "*.md", "!docs/x.md"])
    got = {r.p: r.ig for r in df.select("p", S.ignored(F.col("p"), rules).alias("ig")).collect()}
    assert got == {"src/m.py": False, "src/m.cc": False, "docs/x.md": False, "build/out.py": True,
                   "keep/build/z.py": True}


def test_ignore_rule_syntax():
    cases = {
        "[ab].py": {"a.py": True, "x/b.py": True, "c.py": False, "[ab].py": False},
        "[!ab]?.py": {"cd.py": True, "ad.py": False, "c/.py": False},
        "x[a-c]y": {"xby": True, "xdy": False},
        "*.md   ": {"a.md": True, "a.md   ": False},
        "keep\\ ": {"keep ": True, "keep": False},
        "a**b": {"axxb": True, "a/b": False, "d/ab": True},
        "a/**/b": {"a/b": True, "a/x/y/b": True, "xa/b": False},
        "/top.py": {"top.py": True, "d/top.py": False},
        "logs/**": {"logs/x": True, "logs": False, "d/logs/x": False},
        "\\#x": {"#x": True}, "\\!y": {"!y": True}, "dir/": {"dir/x": True, "dir": False, "a/dir/x": True}, "a.c": {"abc": False, "a.c": True},
    }
    for rule, paths in cases.items():
        regex, negated = S.wildmatch_regex(rule)
        assert not negated
        for path, want in paths.items():
            assert bool(re.search(regex, path)) == want, (rule, path, regex)
    assert S.wildmatch_regex("# c") is None and S.wildmatch_regex("   ") is None
    assert S.wildmatch_regex("!x")[1]


def test_document_and_result_scans(spark):
    folder = tempfile.mkdtemp(prefix="faultline-scan-")
    for name, doc in {"p1.json": [{"bug": "2", "n": 1}, {"bug": "10", "n": 2}], "p2.json": {"bug": "1", "n": 3}, "notes.txt": {"bug": "9", "n": 9}}.items():
        with open(os.path.join(folder, name), "w") as f:
            json.dump(doc, f, indent=1)
    got = S.read_results(spark, folder, "bug string, n int")
    assert sorted((r.project, r.bug, r.n) for r in got.collect()) == [("p1", "10", 2), ("p1", "2", 1), ("p2", "1", 3)]
    assert S.read_documents(spark, os.path.join(folder, "p1.json"), "bug string, n int").count() == 2
    assert [r.bug for r in S.in_numeric_order(got.where("project = 'p1'")).collect()] == ["2", "10"]
    paths = spark.createDataFrame([("p/1/a.py",), ("p/1/b.py",), ("q/x/y/z.py",), ("top",)], "path string")
    assert {tuple(r) for r in S.bugs_of(paths).collect()} == {("p", "1"), ("q", "x")}


def test_corpus_job_from_tree_to_partitioned_table(spark):
    """UDTF-15: files of every (project, bug) to chunks to a table partitioned by both."""
    root = tempfile.mkdtemp(prefix="faultline-corpus-")
    for path, text in {"p/1/a.py": "def f():\n    return 1\n", "p/2/b.py": "x = 1\n", "q/1/c.py": "class C:\n    pass\n"}.items():
        os.makedirs(os.path.join(root, os.path.dirname(path)), exist_ok=True)
        with open(os.path.join(root, path), "w") as f:
            f.write(text)
    tree = S.read_tree(spark, root, "*.py", binary=True).select(S.relative_path(F.col("path"), root).alias("path"), "content")
    part = F.split("path", "/", 3)
    files = tree.select(part[0].alias("project"), part[1].alias("bug"), part[2].alias("file"), "content")
    key = ["project", "bug", "file"]
    ln = source.lines(files, key)
    out = os.path.join(root, "chunks")
    report.write_json(source.chunks(ln, source.spans(ln, key), key), out, partition_by=["project", "bug"])
    back = {(r.project, str(r.bug), r.file, r.name) for r in spark.read.json(out).collect()}
    assert back == {("p", "1", "a.py", "f"), ("p", "2", "b.py", "root"), ("q", "1", "c.py", "C")}


def test_unknown_groups_come_last_and_merges(spark):
    m = spark.createDataFrame([("b", 1), ("z", 2), ("a", 3)], "g string, n int")
    order = report.order_dimension(spark, ["b", "a"], "g", "string")
    assert {(r.g, r.ord) for r in report.ordered_rows(m, order, "g").collect()} == {("b", 0), ("a", 1), ("z", 2)}
    x = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, w int")
    y = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in report.merged(x, y, ["k"]).collect()} == {(1, "a", 1), (2, "c", 2), (3, "d", None)}


def test_bucketed_tables_join_without_a_shuffle(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        x = spark.createDataFrame([("p", i, i) for i in range(20)], "project string, bug int, n int")
        report.write_bucketed(x, "bucketed_chunks", ["project", "bug"], 4)
        a, b = spark.table("bucketed_chunks"), spark.table("bucketed_chunks").withColumnRenamed("n", "m")
        j = a.join(b, ["project", "bug"])
        assert "Exchange" not in j._jdf.queryExecution().executedPlan().toString() and j.count() == 20
    finally:
        spark.sql("drop table if exists bucketed_chunks")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_json_sink_partitioned(spark):
    out = tempfile.mkdtemp(prefix="faultline-sink-")
    ranked = spark.createDataFrame([("p1", "1", 2, "b.py"), ("p1", "1", 1, "a.py"), ("p2", "7", 1, "c.py")],
                                   "project string, bug string, rank int, file string")
    lists = report.ranked_lists(ranked, ["project", "bug"], ["file"])
    report.write_json(lists, os.path.join(out, "r"), partition_by=["project"])
    back = spark.read.json(os.path.join(out, "r"))
    got = {(r.project, r.bug): [x.file for x in r.results] for r in back.collect()}
    assert got == {("p1", "1"): ["a.py", "b.py"], ("p2", "7"): ["c.py"]}


def test_mask_comments_and_docstrings(spark):
    files = spark.createDataFrame([(1, 'def f():\n    """doc"""\n    return 1  # note\n'), (2, 'def f():\n    """doc\n    more\n    """\n    x = "kept"\n')], "f int, content string")
    out = {r.f: r.code for r in source.masked(source.lines(files, ["f"]), ["f"]).collect()}
    assert out[1] == "def f():\n    #--\n    return 1  ##\n\n"
    assert out[2] == 'def f():\n    #--\n    x = "kept"\n'


def test_strip_comments_keeps_short(spark):
    files = spark.createDataFrame([(1, "x = 1  # a long comment\ny = 2  #\n\n\nz = 3\n")], "f int, content string")
    out = source.without_comments(files, source.lines(files, ["f"]), ["f"]).first().code
    assert "a long comment" not in out and "#" in out and "\n\n" not in out
