"""Every query with SQL gives the rows DuckDB gives for it."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else str(int(v)) if v == int(v) else repr(v)
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=str)
    c = con.execute(SQL[name])
    names = [x[0] for x in c.description]
    assert sorted(names) == columns
    place = [names.index(k) for k in columns]
    assert rows == sorted((tuple(norm(r[i]) for i in place) for r in c.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).columns


def test_entry(spark, data):
    assert entry_module.entry(spark).columns
