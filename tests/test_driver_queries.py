"""Every registered query of the library itself against its SQL, at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest

from locusframe import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("events", "part"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def test_each_query_has_sql():
    assert registry.QUERIES.keys() == registry.ORACLE_SQL.keys()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, con):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rel = con.sql(registry.ORACLE_SQL[name])
    assert columns == sorted(rel.columns)
    want = rel.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))
