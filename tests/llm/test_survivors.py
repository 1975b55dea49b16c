import pandas as pd
import pytest

from strandloom.llm import survivors as s

BAD = {"na", "n/a", "none", "-", "?", ""}


def brute(records, trust):
    level = dict(zip(trust.source, trust.trust))
    groups = {}
    for r in records.to_dict("records"):
        if isinstance(r["helm_notation"], str) and r["helm_notation"].strip():
            r["t"] = level.get(r["source"], 0)
            r["w"] = -(10**30) if pd.isna(r["updated_at"]) else r["updated_at"].value
            groups.setdefault(r["helm_notation"].strip(), []).append(r)
    have = lambda g, f: [r for r in g if isinstance(r[f], str) and r[f].strip().lower() not in BAD]
    ids = lambda x: len({i.strip() for i in x.split(";") if i.strip()})
    pick = lambda g, f, k: min(have(g, f), key=k, default={"record_id": None})["record_id"]
    out = []
    for g in groups.values():
        if len(g) > 1:
            out.append((
                min(r["record_id"] for r in g),
                pick(g, "normalized_smiles", lambda r: (-r["t"], -r["w"], r["record_id"])),
                pick(g, "source_ids", lambda r: (-ids(r["source_ids"]), -r["t"], -r["w"], r["record_id"])),
                pick(g, "molecule_type", lambda r: (-r["w"], -r["t"], r["record_id"])),
            ))
    return sorted(out)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_against_brute_force(spark, sf):
    want = brute(pd.read_parquet(f"{sf}/compound_records.parquet"), pd.read_parquet(f"{sf}/source_trust.parquet"))
    assert sorted(map(tuple, s.p5_found(spark, sf).collect())) == want


SCHEMA = "record_id long, compound_chembl_id string, helm_notation string, canonical_smiles string, normalized_smiles string, source_ids string, molecule_type string, source string, helm_smiles_consistent boolean, updated_at timestamp, trust int"


def test_missing_everywhere_and_ties(spark):
    rows = [(i, None, " H ", None, x, None, "?", src, None, None, 9) for i, x, src in [(2, "C", "a"), (1, "N", "a"), (3, " n/A ", "b")]] + [(4, None, None, None, "C", None, None, None, None, None, 1), (5, None, "only", None, "C", None, None, None, None, None, 1)]
    got = s.survivors(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("a", 1), ("b", 5)], "source string, trust int")).collect()
    assert len(got) == 1 and got[0].group_id == 1 and got[0].n_records == 3
    assert (got[0].normalized_smiles_record, got[0].source_ids_record, got[0].molecule_type_record) == (1, None, None)
    assert got[0].normalized_smiles_layer == 1


def test_layers(spark):
    points = spark.createDataFrame([("g", "f", 1, 3, 10, 1, 1, 1), ("g", "f", 1, 2, 10, 2, 1, 1), ("g", "f", 1, 1, 20, 3, 1, 1), ("g", "f", 0, 1, 5, 4, 1, 1)], "group_key string, field string, complete int, trust int, time long, record_id long, n long, least long")
    assert {r.record_id: r.layer for r in s.layers(points).collect()} == {1: 1, 2: 2, 3: 1, 4: 3}


def test_layers_decide(spark):
    """The policy's first holder is passed over if it lies on a lower layer; where layer 1 lacks a field, layer 2 serves it."""
    cell = "group_key string, field string, complete int, trust int, time long, record_id long, n long, least long, layer int"
    rows = [("g", "normalized_smiles", 1, 9, 10, 1, 4, 1, 2), ("g", "normalized_smiles", 1, 2, 20, 2, 4, 1, 1), ("g", "molecule_type", 0, 9, 90, 3, 4, 1, 1), ("g", "molecule_type", 1, 1, 5, 4, 4, 1, 2)]
    got = s.chosen(spark.createDataFrame(rows, cell)).first()
    assert (got.normalized_smiles_record, got.normalized_smiles_layer, got.molecule_type_record, got.molecule_type_layer, got.source_ids_record) == (2, 1, 4, 2, None)


def test_without_dominance_the_rows_change(spark, monkeypatch):
    """Layers by another order (the oldest and least trusted first) give other survivors."""
    sf = "/root/testdata/sf0.001"
    want, layers = sorted(map(tuple, s.p5_found(spark, sf).collect())), s.layers
    turned = lambda p: layers(p.selectExpr("group_key", "field", "complete", "-trust AS trust", "-time AS time", "record_id", "n", "least")).selectExpr("group_key", "field", "n", "least", "complete", "-trust AS trust", "-time AS time", "record_id", "layer")
    monkeypatch.setattr(s, "layers", turned)
    assert sorted(map(tuple, s.p5_found(spark, sf).collect())) != want


def test_empty(spark):
    assert s.survivors(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "source string, trust int")).count() == 0
