"""Queries with SQL give its rows."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from locusframe.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_of_the_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = db.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, DATA).select(*want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
