import re

import pandas as pd
import pytest

from strandloom.llm import format_copies as fc


def squeeze(s):
    return re.sub(r"\s+", "", s)


def helm(s):
    s = squeeze(s)
    s = s[: s.rindex("$") + 1] if "$" in s else s
    parts = s.split("$")
    chains = []
    for p in parts[0].split("|"):
        name, _, rest = p.partition("{")
        chains.append(name.upper() + "{" + ".".join(m[1:-1] if re.fullmatch(r"\[[A-Za-z]\]", m) else m for m in rest.rstrip("}").split(".")))
    links = []
    for c in parts[1].split("|") if len(parts) > 1 and parts[1] else []:
        a, b, ends = c.upper().split(",")
        x, y = ends.split("-")
        links.append(tuple(sorted([(a, x), (b, y)])))
    return tuple(chains), tuple(sorted(links)), tuple(parts[2:])


def smiles(s):
    return tuple(sorted(squeeze(s).split("|")[0].split(".")))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("hot", [50_000, 3])
def test_against_brute_force(spark, sf, hot):
    if hot == 3 and sf.endswith("0.01"):
        pytest.skip("one hot pass is enough")
    df = pd.read_parquet(f"{sf}/chembl_ppi.parquet")
    groups = {}
    for r in df.itertuples():
        if isinstance(r.helm_notation, str) and isinstance(r.normalized_smiles, str) and r.helm_notation.strip() and r.normalized_smiles.strip():
            v = None if pd.isna(r.standard_value) else r.standard_value
            groups.setdefault((helm(r.helm_notation), smiles(r.normalized_smiles), r.target_chembl_id, r.standard_type, r.relation, v), []).append(r.row_id)
    want = sorted((min(ids), x) for ids in groups.values() for x in ids if x != min(ids))
    collapsed, links = fc.copies(spark.read.parquet(f"{sf}/chembl_ppi.parquet"), hot_rows=hot)
    assert sorted(map(tuple, links.collect())) == want
    assert sorted(map(tuple, collapsed.collect())) == sorted((min(ids), len(ids)) for ids in groups.values())


def table(spark, rows):
    return spark.createDataFrame(rows, "row_id long, helm_notation string, normalized_smiles string, target_chembl_id string, standard_type string, relation string, standard_value double, d0k1 string")


def test_nulls_ties_and_long_texts(spark):
    long = "PEPTIDE1{" + ".".join(["A"] * 50_000) + "}$$$$"
    rows = [
        (1, "PEPTIDE1{A.[C]}$PEPTIDE1,PEPTIDE1,2:R2-1:R1$$$", "C.N", None, "Ki", None, None, "x"),
        (2, "peptide1{ [A].C }$peptide1,peptide1,1:r1-2:r2$$$V2.0", "N.C |x|", None, "Ki", None, None, "y"),
        (3, "PEPTIDE1{A.c}$PEPTIDE1,PEPTIDE1,2:R2-1:R1$$$", "C.N", None, "Ki", None, None, "x"),
        (4, None, "C.N", None, "Ki", None, None, None), (5, " ", "C.N", None, "Ki", None, None, None),
        (6, long, "C", "t", "Ki", "=", 1.0, None), (7, long.lower().replace("a", "A").replace("peptide", "PEPTIDE"), "C", "t", "Ki", "=", 1.0, None),
        (8, long, "C", "t", "Ki", "=", 2.0, None), (6, long, "C", "t", "Ki", "=", 1.0, None),
    ]
    groups, links = fc.copies(table(spark, rows))
    assert sorted(map(tuple, links.collect())) == [(1, 2), (6, 7)]
    assert sorted(map(tuple, groups.collect())) == [(1, 2), (3, 1), (6, 3), (8, 1)]


def test_empty(spark):
    groups, links = fc.copies(table(spark, []))
    assert groups.count() == 0 and links.count() == 0
