import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline.functions import encode as E
from faultline.operators import embed, graph
from faultline.operators import evaluate as ev
from faultline.operators.knn import knn_join


def _vectors(spark, n=120, d=8, keys=3, seed=5):
    rnd = np.random.default_rng(seed)
    rows = [(i, i % keys, [float(x) for x in rnd.normal(size=d).astype(np.float32)]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, key int, embedding array<float>")


def test_block_plan_equals_relational_plan(spark):
    v = _vectors(spark)
    # small blocks force many blocks per key
    blk = knn_join(v, v, k=7, query_id="id", corpus_id="id", keys=["key"], exclude_self=True, block_rows=16)
    a = v.alias("a")
    b = v.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") != F.col("b.id"))).select(
        F.col("a.key").alias("key"), F.col("a.id").alias("id"), F.col("b.id").alias("neighbor_id"),
        F.round(E.l2_squared(F.col("a.embedding"), F.col("b.embedding")), 6).alias("distance"))
    w = Window.partitionBy("key", "id").orderBy("distance", "neighbor_id")
    rel = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 7)
    cols = ["key", "id", "rank", "neighbor_id", "distance"]
    assert sorted(map(tuple, blk.select(cols).collect())) == sorted(map(tuple, rel.select(cols).collect()))


def test_fewer_candidates_than_k(spark):
    v = _vectors(spark, n=2, keys=1)
    out = knn_join(v, v, k=60, query_id="id", corpus_id="id")
    assert sorted(r.rank for r in out.where("id = 0").collect()) == [1, 2]


def test_cosine_plan_matches_expression(spark):
    v = _vectors(spark, n=40, keys=1)
    top = knn_join(v, v, k=2, query_id="id", corpus_id="id", metric="cosine", exclude_self=True)
    a, b = v.alias("a"), v.alias("b")
    s = a.join(b, F.col("a.id") != F.col("b.id")).select(
        F.col("a.id").alias("id"), F.col("b.id").alias("neighbor_id"),
        F.round(E.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("score"))
    w = Window.partitionBy("id").orderBy(F.col("score").desc(), "neighbor_id")
    rel = s.withColumn("rank", F.row_number().over(w)).where("rank <= 2")
    cols = ["id", "rank", "neighbor_id", "score"]
    assert sorted(map(tuple, top.select(cols).collect())) == sorted(map(tuple, rel.select(cols).collect()))


def _bfs01(edges, root, max_depth):
    best = {root: 0}
    dq = deque([(root, 0)])
    while dq:
        n, d = dq.popleft()
        if d > best.get(n, 1 << 30):
            continue
        for (s, t, w) in edges:
            if s != n:
                continue
            nd = d + w
            if max_depth is not None and nd > max_depth:
                continue
            if nd < best.get(t, 1 << 30):
                best[t] = nd
                (dq.appendleft if w == 0 else dq.append)((t, nd))
    return best


def test_reachability_vs_python(spark):
    rnd = random.Random(11)
    edges = list({(rnd.randint(0, 25), rnd.randint(0, 25), rnd.choice([0, 0, 1])) for _ in range(70)})
    e = spark.createDataFrame(edges, "src int, dst int, cost int")
    roots = spark.createDataFrame([(r, r) for r in range(0, 26, 5)], "root int, node int")
    for md in (0, 2, None):
        got = {(r.root, r.node, r.depth) for r in graph.reachability(e, roots, max_depth=md).collect()}
        want = {(r, n, d) for r in range(0, 26, 5) for n, d in _bfs01(edges, r, md).items()}
        assert got == want


def test_cycle_terminates(spark):
    # golden: a->b (same file), b->c (imported), c->a
    e = spark.createDataFrame([("a", "b", 0), ("b", "c", 1), ("c", "a", 0)], "src string, dst string, cost int")
    roots = spark.createDataFrame([("a", "a")], "root string, node string")
    d0 = {r.node for r in graph.reachability(e, roots, max_depth=0).collect()}
    assert d0 == {"a", "b"}
    full = {r.node for r in graph.reachability(e, roots).collect()}
    assert full == {"a", "b", "c"}
    v0 = graph.reachability(e, roots, max_depth=0)
    calls = spark.createDataFrame([("a", "b", "b", 0, None), ("b", "c", "c", 1, None), ("b", "len", None, 1, "external"), ("a", "m.x", None, 1, "no_module"), ("a", "y", None, 0, "no_function")],
                                  "src string, callee string, dst string, cost int, status string")
    tree = {(r.src, r.callee, r.label) for r in graph.call_tree(v0, calls, 0).collect()}
    assert tree == {("a", "b", None), ("b", "c", "Max depth reached"), ("b", "len", "External or builtin function"), ("a", "m.x", "Module file not found"), ("a", "y", "Function not found")}


def test_walk_is_whole_or_an_error(spark):
    e = spark.createDataFrame([(k, i, i + 1, 0) for k in (1, 2) for i in range(6)], "k int, src int, dst int, cost int")
    roots = spark.createDataFrame([(1, 0, 0), (2, 3, 3)], "k int, root int, node int")
    got = {(r.k, r.node) for r in graph.reachability(e, roots, keys=["k"]).collect()}
    assert got == {(1, n) for n in range(7)} | {(2, n) for n in range(3, 7)}
    for depth in (0, None):
        with pytest.raises(RuntimeError):
            graph.reachability(e, roots, keys=["k"], max_depth=depth, max_rounds=3)


def test_module_resolution(spark):
    mods = spark.createDataFrame([("pkg.util.f",), ("pkg.other.g",), ("none.h",)], "module string")
    files = spark.createDataFrame([("pkg/util.py",), ("pkg/other/__init__.py",)], "path string")
    got = {r.module: r.resolved for r in graph.resolve_module(mods, files).collect()}
    assert got == {"pkg.util.f": "pkg/util.py", "pkg.other.g": "pkg/other/__init__.py", "none.h": None}


def test_hash_encoder_forms_agree(spark):
    df = spark.createDataFrame([(1, "Hello wörld, hello again_1"), (2, ""), (3, None)], "i int, t string")
    a = {r.i: r.embedding for r in E.hash_vectors(df, ["i"], "t").collect()}
    b = {r.i: r.v for r in df.select("i", E.hash_encode_sql(F.col("t")).alias("v")).collect()}
    assert np.allclose(a[1], b[1]) and np.allclose(a[2], b[2])
    assert abs(sum(a[1]) - 1.0) < 1e-12 and sum(a[2]) == 0 and sum(a[3]) == 0


def _nodes(df, word):
    return df._jdf.queryExecution().executedPlan().toString().count(word)


def test_encoder_runs_once_for_each_distinct_text(spark):
    rows = spark.createDataFrame([(i, None if i == 7 else "hot text" if i % 3 else f"text {i}") for i in range(300)], "i int, t string").repartition(6)
    seen = spark.sparkContext.accumulator(0)

    def make():
        def predict(texts):
            seen.add(len(texts))
            return [[float(len(t)), 1.0] for t in texts]
        return predict

    out = embed.embed_once(rows, "t", embed.model_encoder(make, 16)).where("embedding is not null")
    assert _nodes(out, "MapInPandas") == 1
    got = {r.i: r.embedding for r in out.collect()}
    assert seen.value == 101 and len(got) == 299 and got[1] == [8.0, 1.0]
    kept = embed.embed_once(rows, "t").collect()
    assert len(kept) == 300 and [r.embedding for r in kept if r.i == 7] == [None]
    assert not any(w in embed.embed_once(rows, "t")._jdf.queryExecution().executedPlan().toString() for w in ("Python", "Pandas", "Arrow"))


def test_no_nested_loop_over_a_data_side(spark):
    v = _vectors(spark)
    for threshold in ("-1", "10485760"):
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            for keys in ([], ["key"]):
                plan = knn_join(v, v, k=3, query_id="id", corpus_id="id", keys=keys)._jdf.queryExecution().toString()
                assert "NestedLoop" not in plan and "Cartesian" not in plan
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_hot_key_and_payloads(spark):
    rows = [(i, 0 if i % 3 else i, [float(i), 1.0], f"n{i}") for i in range(240)]
    v = spark.createDataFrame(rows, "id long, key long, embedding array<double>, name string")
    out = knn_join(v, v, k=1, query_id="id", corpus_id="id", keys=["key"], exclude_self=True, block_rows=10, corpus_payload=["name"])
    got = {r.id: (r.neighbor_id, r.name, r.distance) for r in out.collect()}
    assert got[100] == (101, "n101", 1.0) and got[1] == (0, "n0", 1.0) and 3 not in got


def test_query_without_candidates_is_a_failure(spark):
    ranked = spark.createDataFrame([("a", 1, 1)], "q string, rank int, rel int")
    qs = spark.createDataFrame([("a",), ("b",)], "q string")
    per = ev.average_precision(ranked, ["q"], queries=qs)
    assert {(r.k, r.passed, r.failed) for r in ev.success_at_k(per, ks=[1]).collect()} == {(1, 1, 1)}
    assert ev.map_mrr(per).first().map == 0.5


def test_masked_mean(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "v array<array<double>>, m array<int>")
    assert df.select(E.masked_mean(F.col("v"), F.col("m"), 2).alias("x")).first().x == [2.0, 3.0]
