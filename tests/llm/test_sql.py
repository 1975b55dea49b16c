"""Every query of the subpackage: against DuckDB where it has SQL, else that it runs and keeps every row it should."""

import glob
import os

import duckdb
import pytest

from strandloom.llm import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, small, name):
    got = QUERIES[name](spark, small)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names)
    order = [names.index(c) for c in got.columns]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(tuple(row[i] for i in order)) for row in cur.fetchall())


def test_others(spark, small):
    shares = {(r.table_name, r.split): r.share for r in QUERIES["p1_shares"](spark, small).collect()}
    assert sum(v for (t, _), v in shares.items() if t == "chembl_ppi") == pytest.approx(1, abs=1e-5)
    fill = QUERIES["p9_fill"](spark, small).first()
    assert fill.most_tokens <= 2048 and fill.fill > 0.9
    found, full = QUERIES["p5_found"](spark, small), QUERIES["p5_survivors"](spark, small)
    assert found.count() == full.count() == full.where("normalized_smiles IS NOT NULL").count()
