import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.operators.knn import knn_join
from faultline.operators.knn_pruned import knn_pruned


def clustered(spark, n=900, d=6, groups=30, seed=3, spread=0.02):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(groups, d)) * 3
    v = centres[rnd.integers(groups, size=n)] + rnd.normal(size=(n, d)) * spread
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<double>")


def both(q, c, **kw):
    counted: dict = {}
    args = {"query_id": "id", "corpus_id": "id", **kw}
    got = knn_pruned(q, c, counted=counted, cell_rows=30, **args)
    want = knn_join(q, c, **args)
    rows = lambda df: sorted(tuple(r[x] for x in got.columns) for r in df.collect())
    assert rows(got) == rows(want)
    return counted


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_same_rows_and_most_cells_skipped(spark, metric):
    v = clustered(spark)
    counted = both(v, v, k=5, metric=metric, exclude_self=True)
    assert counted["all"] == 900 * 30 and counted["met"] < counted["all"] / 4


def test_small_blocks_few_candidates_and_ties(spark):
    v = clustered(spark, n=200, groups=3, spread=0)  # many equal vectors
    both(v.where("id % 3 = 0"), v, k=7, exclude_self=True, block_rows=16)
    both(v, v.limit(4), k=9)


def test_without_structure_results_are_the_same(spark):
    rnd = np.random.default_rng(1)
    v = spark.createDataFrame([(i, [float(x) for x in rnd.normal(size=20)]) for i in range(300)], "id long, embedding array<double>")
    both(v, v, k=3, metric="cosine", exclude_self=True)


def test_unusable_vectors_and_empty_sides(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [0.5, 0.5]), (5, [])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    out = knn_pruned(v, v, k=2, query_id="id", corpus_id="id", metric="cosine", exclude_self=True)
    assert sorted((r.id, r.neighbor_id) for r in out.collect()) == [(1, 4), (4, 1)]
    assert knn_pruned(v, v.limit(0), k=2, query_id="id", corpus_id="id").collect() == []
    assert knn_pruned(v.limit(0), v, k=2, query_id="id", corpus_id="id").collect() == []


def test_candidates_of_the_product_hold_the_exact_best():
    from faultline.operators.knn import _distance_tile, _local_topk

    rnd = np.random.default_rng(5)
    far = rnd.normal(size=(200, 16)) + 1e4  # the product loses digits here
    for metric, v in (("l2", far), ("l2", np.repeat(far[:20], 10, axis=0)), ("cosine", far), ("l2", far * 1e200), ("cosine", np.where(far > 1e4 + 2, 0, far) * 1e-170)):
        ids = np.arange(len(v))
        with np.errstate(over="ignore", invalid="ignore"):
            exact = np.round(_distance_tile(v, v, metric), 6)
            at_q, at_c, value = _local_topk(ids, v, ids, v, 5, metric, True)
        key = np.where(np.isnan(exact), np.inf, exact if metric == "l2" else -exact)
        np.fill_diagonal(key, np.inf)
        want = {(i, j) for i in ids for j in np.flatnonzero((key[i] <= np.sort(key[i])[4]) & np.isfinite(key[i]))}
        assert want <= set(zip(at_q.tolist(), at_c.tolist())) and (value == exact[at_q, at_c]).all()
        assert len(at_q) <= 2 * len(want)


def test_a_query_goes_once_to_a_bundle_of_cells(spark):
    from faultline.operators.knn_pruned import _Space, visits

    rnd = np.random.default_rng(2)
    v = rnd.normal(size=(64, 8))
    cells = pd.DataFrame({"cell": range(64), "n": [10] * 64, "radius": [9.0] * 64})
    q = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "_qid long, _qv array<double>").withColumn("_kth", F.lit(None).cast("double"))
    out = visits(q, _Space(v, "l2"), cells, 10, False, bundle=16)
    assert out.count() == 64 * 4 and out.agg(F.sum(F.bit_count("_bits"))).first()[0] == 64 * 63


def test_copies_follow_blocks_of_queries_not_cells(spark, monkeypatch):
    """Without structure every query meets every cell; no table that is kept holds a row for each of these."""
    from faultline.operators import knn_pruned as module

    kept, plain = [], module.cut

    def cut(df, tag):
        out = plain(df, tag)
        kept.append((tag, out.count()))
        return out

    monkeypatch.setattr(module, "cut", cut)
    rnd = np.random.default_rng(6)
    v = spark.createDataFrame([(i, [float(x) for x in rnd.normal(size=20)]) for i in range(400)], "id long, embedding array<float>")
    for metric in ("l2", "cosine"):
        assert both(v, v, k=3, metric=metric, exclude_self=True, block_rows=16)["all"] == 400 * 14
    assert max(n for _, n in kept) <= 3 * 400, kept


def test_rows_of_one_query_id_share_its_best(spark):
    rnd = np.random.default_rng(7)
    v = spark.createDataFrame([(i // 2 if i < 60 else (None if i < 64 else i), [float(x) for x in rnd.integers(-2, 3, size=3)]) for i in range(300)], "id long, embedding array<float>")
    args = {"k": 4, "query_id": "id", "corpus_id": "id"}
    got, want = knn_pruned(v, v, cell_rows=30, block_rows=16, **args), knn_join(v, v, **args)
    rows = lambda df: sorted(map(repr, (tuple(r[x] for x in got.columns) for r in df.collect())))
    assert rows(got) == rows(want)
