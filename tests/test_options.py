from pyspark.sql import functions as F

from faultline.operators import evaluate as ev
from faultline.operators import source


def test_average_precision_over_all_relevant_items(spark):
    ranked = spark.createDataFrame([("a", 1, 1), ("a", 2, 0), ("a", 3, 1), ("b", 1, 0)], "q string, rank int, rel int")
    n = spark.createDataFrame([("a", 4), ("b", 2)], "q string, n_relevant int")
    got = {r.q: r.ap for r in ev.average_precision(ranked, ["q"], relevant=n).collect()}
    assert got == {"a": round((1 + 2 / 3) / 4, 6), "b": 0.0}
    # without the table, and for a query that it doesn't name, no division by zero
    assert {r.q: r.ap for r in ev.average_precision(ranked, ["q"]).collect()}["a"] == round((1 + 2 / 3) / 2, 6)
    assert ev.average_precision(ranked, ["q"], relevant=n.limit(0)).count() == 2


def test_files_match_by_name_or_by_path(spark):
    ranked = spark.createDataFrame([(1, 1, "a/__init__.py"), (1, 2, "b/__init__.py"), (1, 3, "b/c.py")], "q int, rank int, path string")
    truth = spark.createDataFrame([(1, "b/__init__.py"), (1, "b/__init__.py"), (2, "b/c.py")], "q int, path string")
    rel = lambda match: [r.rel for r in ev.path_relevance(ranked, truth, ["q"], "path", match=match).orderBy("rank").collect()]
    assert rel("basename") == [1, 1, 0] and rel("path") == [0, 1, 0]


def test_what_a_definition_covers(spark):
    text = "x = 1\ndef f():\n    a = 1\n    return [\n        a]\ny = 2"
    src = spark.createDataFrame([(0, text)], "f int, content string")
    ln, found = source.facts(src, ["f"])
    root = lambda **kw: source.chunks(ln, found, ["f"], **kw).where(F.col("name") == "root").first().code
    assert root() == "x = 1\n        a]\ny = 2" and root(cover="end_line") == "x = 1\ny = 2"


def test_files_of_a_tree_hold_a_bounded_number_of_modules(spark, tmp_path, monkeypatch):
    from faultline.plans import options

    rows = [(i, f"blue part {i}", f"Brand#{i % 2}", "SMALL", i % 7 + 1) for i in range(40)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    sizes, plain = [], options.files.read_tree

    def read_tree(spark, root, glob):
        tree = plain(spark, root, glob)
        sizes.append(tree.select(F.regexp_count("content", F.lit("class Part")).alias("n")).toPandas()["n"].tolist())
        return tree

    monkeypatch.setattr(options.files, "read_tree", read_tree)
    found = [sorted(map(tuple, options.tree_corpus(spark, str(tmp_path)).collect()))]
    monkeypatch.setattr(options, "MODULES", 6, raising=False)
    found.append(sorted(map(tuple, options.tree_corpus(spark, str(tmp_path)).collect())))
    assert found[0] == found[1] and [r[0] for r in found[0]] == ["Brand_0", "Brand_1"]
    assert sum(sizes[0]) == sum(sizes[1]) > 0 and max(sizes[1]) <= 6
