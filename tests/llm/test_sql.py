"""Queries with SQL give DuckDB's rows over whole tables."""

import time

import duckdb
import pytest

from spanforge.llm import queries
from tests.test_queries import TABLES, rows_of


@pytest.mark.parametrize("name", queries.SQL)
def test_matches_sql(spark, name):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{d}/{t}.parquet'")
    began = time.time()
    want = con.sql(queries.SQL[name])
    rows = rows_of(want.columns, want.fetchall())
    print(name, "SQL took", round(time.time() - began, 1))
    got = queries.QUERIES[name](spark, d)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows
