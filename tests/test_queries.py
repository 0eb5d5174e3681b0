"""Every query with SQL gives DuckDB's rows on the same tables."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SCALES = ["sf0.001", "sf0.01"]
LIBRARY = [k for k in entry.queries() if not (k[:2] == "op" and k[2].isdigit()) and k != "pipeline"]


def plain(v):
    if v is None or isinstance(v, (bool, str, datetime.datetime)):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("scale", SCALES)
@pytest.mark.parametrize("name", [k for k in LIBRARY if k in entry.oracle_sql()])
def test_matches_sql(spark, name, scale):
    d = f"/root/testdata/{scale}"
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as from '{d}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, d)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", [k for k in LIBRARY if k not in entry.oracle_sql()])
def test_runs(spark, name):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10522
