import re
from datetime import datetime

import pandas as pd
import pytest

from strandloom.operators import orphans as o


def brute(sf):
    library = pd.read_parquet(f"{sf}/monomer_library.parquet")
    held = {}
    for r in library.itertuples():
        for s in {r.symbol.strip()} | {x.strip() for x in re.split(r"[;|]", r.alt_symbols or "") if x.strip()}:
            held.setdefault(s, []).append((r.added_at, r.deleted_at))
    out = []
    for table, helm in (("chembl_ppi", "helm_notation"), ("permeability_peptides", "helm")):
        for row, text, at in pd.read_parquet(f"{sf}/{table}.parquet")[["row_id", helm, "loaded_at"]].itertuples(index=False):
            symbols = {m.removeprefix("[").removesuffix("]") for b in re.findall(r"(?i)PEPTIDE\d*\{([^}]*)\}", re.sub(r"\s", "", text or "")) for m in b.split(".")} - {""}
            for s in symbols:
                spans = held.get(s)
                if spans is None:
                    out.append((table, row, s, "missing"))
                elif not any(a <= at and (pd.isna(d) or at < d) for a, d in spans):
                    out.append((table, row, s, "deleted" if any(d <= at for _, d in spans if not pd.isna(d)) else "late"))
    return sorted(out)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_against_brute_force(spark, sf):
    assert sorted(map(tuple, o.p7_found(spark, sf).collect())) == brute(sf)


KEYS = "row_id long, at timestamp, key string"
HELD = "row_id long, key string, since timestamp, until timestamp"


def test_cascade(spark):
    t = datetime(2024, 1, 1)
    a = spark.createDataFrame([(1, "a", None, None), (2, "b", None, None)], HELD)
    b_refs = spark.createDataFrame([(10, t, "a"), (11, t, "gone"), (12, t, None)], KEYS)
    b = spark.createDataFrame([(10, "x", None, None), (11, "y", None, None), (12, "z", None, None), (13, "y2", None, None)], HELD)
    c_refs = spark.createDataFrame([(20, t, "y"), (21, t, "x"), (22, t, "nowhere"), (23, None, "y")], KEYS)
    c = spark.createDataFrame([(20, "k", None, None), (21, "l", None, None)], HELD)
    d_refs = spark.createDataFrame([(30, t, "k"), (31, t, "l")], KEYS)
    got = o.orphan_cascade([o.Reference("b", b_refs, "a", a), o.Reference("c", c_refs, "b", b), o.Reference("d", d_refs, "c", c)])
    assert sorted((r.table_name, r.row_id, r.kind, r.depth) for r in got.collect()) == [("b", 11, "missing", 0), ("c", 20, "inherited", 1), ("c", 22, "missing", 0), ("c", 23, "inherited", 1), ("d", 30, "inherited", 2)]


def test_self_reference_and_empty(spark):
    t = datetime(2024, 1, 1)
    held = spark.createDataFrame([(1, "a", None, None), (2, "b", None, None), (3, "c", None, None)], HELD)
    refs = spark.createDataFrame([(1, t, "gone"), (2, t, "a"), (3, t, "b")], KEYS)
    got = o.orphan_cascade([o.Reference("t", refs, "t", held)])
    assert sorted((r.row_id, r.depth) for r in got.collect()) == [(1, 0), (2, 1), (3, 2)]
    assert o.orphan_cascade([o.Reference("t", refs.limit(0), "t", held.limit(0))]).count() == 0


def test_spans(spark):
    t = lambda y: datetime(y, 1, 1)
    held = spark.createDataFrame([(1, "s", t(2020), t(2021)), (2, "s", t(2023), None)], HELD)
    refs = spark.createDataFrame([(1, t(2019), "s"), (2, t(2020), "s"), (3, t(2021), "s"), (4, t(2023), "s"), (5, None, "s"), (6, None, "no")], KEYS)
    got = o.orphan_cascade([o.Reference("c", refs, "p", held)])
    assert sorted((r.row_id, r.kind) for r in got.collect()) == [(1, "late"), (3, "deleted"), (6, "missing")]


def test_unfinished_cascade_is_an_error(spark):
    t = datetime(2024, 1, 1)
    held = spark.createDataFrame([(i, str(i), None, None) for i in range(4)], HELD)
    refs = spark.createDataFrame([(i, t, str(i - 1)) for i in range(4)], KEYS)
    with pytest.raises(RuntimeError):
        o.orphan_cascade([o.Reference("t", refs, "t", held)], max_rounds=2)
    assert sorted(r.depth for r in o.orphan_cascade([o.Reference("t", refs, "t", held)]).collect()) == [0, 1, 2, 3]


def test_report_has_inherited_orphans(spark):
    """An entry whose analog comes later makes the rows of its symbol inherit; one other holder saves them."""
    t = lambda y: datetime(y, 1, 1)
    library = spark.createDataFrame([(1, "A", None, t(2021), None), (2, "meA", "A", t(2020), None), (3, "Z", "meA", t(2022), None), (4, "Q", "X", t(2020), None)], "monomer_id long, symbol string, natural_analog string, added_at timestamp, deleted_at timestamp").selectExpr("*", "cast(null as string) AS alt_symbols")
    held, refs = o.library_holdings(library), o.analog_references(library)
    rows = spark.createDataFrame([(10, t(2023), "Z"), (11, t(2023), "A"), (12, t(2023), "meA"), (13, t(2023), "no")], KEYS)
    cascade = lambda h: sorted((r.table_name, r.row_id, r.kind, r.depth) for r in o.orphan_cascade([o.Reference("rows", rows, "lib", h), o.Reference("lib", refs, "lib", h)]).collect())
    assert cascade(held) == [("lib", 2, "late", 0), ("lib", 3, "inherited", 1), ("rows", 10, "inherited", 2), ("rows", 12, "inherited", 1), ("rows", 13, "missing", 0)]
    more = held.unionByName(spark.createDataFrame([(5, "meA", t(2020), None)], HELD))
    assert cascade(more) == [("lib", 2, "late", 0), ("rows", 13, "missing", 0)]


def test_report_over_the_tables(spark, small):
    got = o.p7_report(spark, small).groupBy("origin").count().collect()
    assert {r.origin for r in got} == {"direct", "inherited"}
