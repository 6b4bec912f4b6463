"""Every registered query with an oracle, against DuckDB on the smallest tables."""

import os

import pytest

from faultline.plans import registry
from faultline.sources.tables import TABLES, table_path
from scripts.oracle_check import digest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF, t)}')")
    return con


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    want = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    rows = want.fetchall()
    assert sorted(df.columns) == sorted(columns) and len(got) == len(rows)
    assert digest(df.columns, got)[0] == digest(columns, rows)[0]
    assert rows or name == "min_group_size", "a query without rows checks nothing"  # no source has 20 documents there
