"""Every query with SQL gives the rows of that SQL on the smallest tables, where these are there."""

import os

import pytest

import __spark_entry__ as entry
from feedloom.plans import catalogue

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no tables")


def cell(v):
    import pandas as pd

    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "null"
    if isinstance(v, float) and v == int(v):
        return str(int(v))
    if isinstance(v, pd.Timestamp):
        return str(v.tz_localize(None) if v.tzinfo else v)
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted("|".join(map(cell, r)) for r in frame.itertuples(index=False))


def compare(spark, name, query, sql):
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(D):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    assert rows(query(spark, D).toPandas()) == rows(con.sql(sql).df()), name


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, name):
    compare(spark, name, catalogue.QUERIES[name], catalogue.SQL[name])


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
