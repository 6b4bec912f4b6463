import os

import pytest

import __spark_entry__ as ent

SF001 = "/root/testdata/sf0.001"


def test_registry_has_oracles_for_most():
    q, o = ent.queries(), ent.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50


@pytest.mark.skipif(not os.path.exists(SF001), reason="driver test data not present")
def test_entry_smoke(spark):
    df = ent.entry(spark)
    rows = df.collect()
    assert {r.k for r in rows} == {1, 5, 10}
    assert all(r.passed + r.failed == r.total for r in rows)
