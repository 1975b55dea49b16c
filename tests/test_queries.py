"""Every core query with SQL, held against DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from strandloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool) or isinstance(v, str):
        return str(v)
    try:
        return repr(round(float(v), 6))
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, small, name):
    got = QUERIES[name](spark, small)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names)
    order = [names.index(c) for c in got.columns]
    want = sorted(tuple(plain(row[i]) for i in order) for row in cur.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
