"""Queries of the subpackage against their SQL on the small tables."""

import math
import os

import duckdb
import pytest

from lithoframe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, data, name):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    ours, theirs = queries.QUERIES[name](spark, data), con.sql(queries.SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in columns]
    text = lambda v: "none" if v is None or isinstance(v, float) and math.isnan(v) else f"{float(v):.6g}" if isinstance(v, (int, float)) else str(v)
    assert sorted(tuple(text(r[c]) for c in columns) for r in ours.collect()) == sorted(tuple(text(r[i]) for i in at) for r in theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0
