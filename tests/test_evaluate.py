from pyspark.sql import functions as F

from faultline.operators import evaluate as ev


def _ranked(spark, rows):
    return spark.createDataFrame(rows, "q string, rank int, rel int")


def test_ap_rr_golden(spark):
    # AGG-01/02 golden: [0,1,0,1,1] -> 0.533333 / 0.5; [0,0] -> 0 / 0; [1] -> 1 / 1
    rows = [("a", i + 1, r) for i, r in enumerate([0, 1, 0, 1, 1])]
    rows += [("b", 1, 0), ("b", 2, 0), ("c", 1, 1)]
    out = {r.q: (r.ap, r.rr) for r in ev.average_precision(_ranked(spark, rows), ["q"]).collect()}
    assert out == {"a": (0.533333, 0.5), "b": (0.0, 0.0), "c": (1.0, 1.0)}


def test_success_at_k_monotone(spark):
    rows = [("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("b", 1, 1), ("c", 1, 0)]
    pq = ev.average_precision(_ranked(spark, rows), ["q"])
    s = {r.k: (r.passed, r.failed, r.total) for r in ev.success_at_k(pq, ks=[1, 2, 3]).collect()}
    assert s == {1: (1, 2, 3), 2: (1, 2, 3), 3: (2, 1, 3)}
    rates = [ev.success_at_k(pq, ks=[k]).first().success_rate for k in (1, 2, 3)]
    assert rates == sorted(rates)


def test_all_required(spark):
    # AGG-05: nothing required passes (n_required 0); {a,b} vs predicted [a,c] fails
    req = spark.createDataFrame([("q2", "a"), ("q2", "b")], "q string, item string")
    pred = spark.createDataFrame([("q1", "x", 1), ("q2", "a", 1), ("q2", "c", 2)], "q string, item string, rank int")
    out = {(r.q, r.k): (r.n_required, r.passed) for r in ev.all_required_at_k(req, pred, ["q"], "item", ks=[5]).collect()}
    assert out == {("q1", 5): (0, True), ("q2", 5): (2, False)}


def test_majority_rule(spark):
    # AGG-06: 2 items, 1 found -> failed; 3 items, 2 found -> passed; no result -> skipped; 0 items -> failed
    items = spark.createDataFrame(
        [("a", True), ("a", False), ("b", True), ("b", True), ("b", False)], "q string, found boolean")
    qs = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", True)], "q string, has_result boolean")
    out = {r.q: r.state for r in ev.classify_majority(items, qs, ["q"]).collect()}
    assert out == {"a": "failed", "b": "passed", "c": "skipped", "d": "failed"}
    rates = ev.rates_with_skips(ev.classify_majority(items, qs, ["q"])).first()
    assert (rates.passed, rates.failed, rates.skipped, rates.consistent) == (1, 2, 1, True)
    assert rates.rate_without_skips == round(1 / 3, 6)
