"""Every core query against its SQL on the small tables."""

import math
import os

import duckdb
import pytest

from lithoframe.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def normal(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "none"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6g}"
    return str(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, duck, name):
    ours = QUERIES[name](spark, data)
    theirs = duck.sql(SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    got = sorted(tuple(normal(r[c]) for c in columns) for r in ours.collect())
    at = [theirs.columns.index(c) for c in columns]
    want = sorted(tuple(normal(r[i]) for i in at) for r in theirs.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "fold" in entry.entry(spark).columns
