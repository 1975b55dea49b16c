import random

import pytest

from strandloom.functions import molgraph as g
from strandloom.operators import chemistry as ch


def rewritten(m, seed):
    """Another way to write a molecule: atoms renumbered at random, then written from another start."""
    r = random.Random(seed)
    order = list(range(len(m.atoms)))
    r.shuffle(order)
    at = {old: new for new, old in enumerate(order)}
    n = g.Molecule()
    for old in order:
        a = m.atoms[old]
        n.add(g.Atom(a.symbol, a.aromatic, a.charge, a.isotope, a.hydrogens, a.label, a.turn, [x if x == g.HYDROGEN else at[x] for x in a.order], a.bracket))
    for a, near in enumerate(m.bonds):
        for b, o in near.items():
            if a < b:
                n.bond(at[a], at[b], o)
    return n


MOLECULES = ["N[C@@H](C)C(=O)O", "CC(C)(C)c1ccc2[nH]ccc2c1", "[*:1]N[C@@H](CC1(CC1)C(F)(F)C)C(=O)[*:2]", "N9[C@@H](CC(C)C)C(=O)N[C@H](C(C)C)C9=O", "C[C@H](O)[C@@H](N)C(=O)O.Cl", "c1ccc(cc1)-c1ccccc1", "C12C3C4C1C5C2C3C45", "CS(=O)(=O)c1cc(sc1)C#N", "[NH4+].[O-]C=O", "C[C@]12CCC[C@H]1CCC2", "C1CC1.C1CC1.C1CCCCC1", "C1CCC2CCCCC2C1.C1CCC(C1)C1CCCC1", "C1C2CC3CC1CC(C2)C3", "CC[S@](=O)C", "c1ccc2cc3ccccc3cc2c1", "C1CC2CC1CC2C1CC1"]


@pytest.mark.parametrize("text", MOLECULES)
def test_canonical_text_does_not_depend_on_writing(text):
    m = g.parse(text)
    want = g.canonical(m)
    assert g.canonical_smiles(want) == want
    for seed in range(8):
        assert g.canonical(rewritten(m, seed)) == want
        assert g.fingerprint(rewritten(m, seed)) == g.fingerprint(m)


def test_stereo_and_kekule():
    assert g.canonical_smiles("N[C@@H](C)C(=O)O") == g.canonical_smiles("C[C@H](N)C(=O)O") != g.canonical_smiles("N[C@H](C)C(=O)O")
    assert g.canonical_smiles("C1=CC=C(C=C1)C1=CC=CC=C1") == g.canonical_smiles("c1ccc(cc1)c1ccccc1")
    assert g.canonical_smiles("F[C@@H](F)Cl") == g.canonical_smiles("FC(F)Cl")
    assert g.canonical(g.mirrored(g.parse("N[C@@H](C)C(=O)O"))) == g.canonical_smiles("N[C@H](C)C(=O)O")
    assert g.canonical_smiles("N[C@@H](C)C(=O)O", stereo=False) == g.canonical_smiles("NC(C)C(=O)O")


def test_groups_and_methyl():
    same = {g.canonical_smiles(x) for x in ("[*:1]N[C@@H](C)C(=O)[*:2]", "[1*]N[C@@H](C)C(=O)[2*]", "[R2]C(=O)[C@H](C)N[R1]", "*N[C@@H](C)C(=O)* |$_R1;_R2$|")}
    assert len(same) == 1 and g.group_labels(g.parse(same.pop())) == [1, 2]
    assert g.canonical(g.n_methylated(g.parse("[*:1]N[C@@H](C)C(=O)[*:2]"))) == g.canonical_smiles("[*:1]N(C)[C@@H](C)C(=O)[*:2]")
    assert g.n_methylated(g.parse("CCN")) is None


@pytest.mark.parametrize("text,want", [("CCc1ccccc1", "c1ccccc1"), ("CCCC", ""), ("c1ccccc1CCC1CC1C", "c1ccccc1CCC1CC1"), ("CC1CCC(=O)N1", "C1CCC(=O)N1"), ("OC(=O)c1ccccc1", "c1ccccc1")])
def test_scaffold(text, want):
    assert g.scaffold(g.parse(text)) == (g.canonical_smiles(want) or "")


def test_long_molecules():
    """No bound on the size: a long chain, and a long peptide in two ways to write it."""
    chain = g.canonical_smiles("C" * 30_000)
    assert chain.count("C") == 30_000 and g.canonical_smiles(chain) == chain
    m = g.parse("N[C@@H](CC(C)C)C(=O)" * 1_200 + "O")
    assert len(m.atoms) > 9_000
    assert g.canonical(rewritten(m, 1)) == g.canonical(m)
    assert g.canonical_smiles("C[S@](=O)CC") == g.canonical_smiles("CC[S@@](=O)C") != g.canonical_smiles("C[S@@](=O)CC")


@pytest.mark.parametrize("text", ["", None, "C1CC", "C(", "[Zz]", "CC)", "=", "1CC1", "C11", "(((("])
def test_odd_texts(text):
    assert g.canonical_smiles(text) is None


def test_neighbours_against_all_pairs(spark):
    from strandloom.operators import chemistry as ch

    r = random.Random(1)
    rows = [(str(i), sorted(r.sample(range(40), 15))) for i in range(30)]
    got = {(x.k, x.other): x.similarity for x in ch.neighbours(spark.createDataFrame(rows, "k string, bits array<int>"), "k").collect()}
    near = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in rows for b, y in rows if a < b}
    assert all(abs(near[p] - s) < 1e-9 for p, s in got.items())
    missed = [p for p, s in near.items() if s >= 0.45 and p not in got]
    assert not missed


def test_nearest_of_against_all_pairs(spark):
    from pyspark.sql import functions as F

    from strandloom.operators import chemistry as ch

    r = random.Random(2)
    rows = [(str(i), sorted(r.sample(range(2048), r.choice([2, 20, 60]))), i % 3 == 0) for i in range(60)] + [("none", None, True)]
    df = spark.createDataFrame(rows, "k string, bits array<int>, t boolean")
    sets = {k: (set(b), t) for k, b, t in rows if b}
    alike = lambda a, b: len(sets[a][0] & sets[b][0]) / len(sets[a][0] | sets[b][0])
    want = {a: [max(alike(a, b) for b in sets if b != a), max(alike(a, b) for b in sets if not sets[b][1]) if sets[a][1] else None] for a in sets}
    every = F.lit(True)
    for block in (7, 2000):
        got = {x.k: x.nearest for x in ch.nearest_of(df, "k", F.array(every, "t"), F.array(every, ~F.col("t")), block=block).collect()}
        assert got == {a: [pytest.approx(x) for x in v] for a, v in want.items()}
    assert ch.nearest_of(df.limit(1), "k", F.array(every), F.array(every)).first().nearest == [None]


def test_every_scaffold_has_its_nearest(spark, tmp_path):
    from strandloom.plans.chem_queries import scaffold_novelty, scaffold_rarity

    texts = ["c1ccccc1", "C1CCCCC1", "C1CC1", "O1CCOCC1", "c1ccsc1", "N1CCNCC1", "C1CCC2CCCCC2C1", "c1cc[nH]c1", "S1CCSC1", "not a structure", "", None, "__no_scaffold__"]
    rows = [(i, "C", s, None, None) for i, s in enumerate(texts)]
    spark.createDataFrame(rows, "row_id long, smiles string, scaffold string, pampa double, caco2 double").write.parquet(f"{tmp_path}/permeability_peptides.parquet")
    prints = {s: set(g.fingerprint(g.parse(s))) for s in texts[:9]}
    alike = lambda a, b: len(prints[a] & prints[b]) / len(prints[a] | prints[b])
    want = {a: round(max(alike(a, b) for b in prints if b != a), 6) for a in prints} | {"not a structure": None, "__no_scaffold__": None}
    assert {x.given: x.nearest for x in scaffold_rarity(spark, str(tmp_path)).collect()} == want
    import hashlib

    test = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:4], 16) % 5 == 0
    picked = {s: max(alike(s, b) for b in prints if not test(b)) if s in prints else 1.0 for s in want if test(s)}
    got = scaffold_novelty(spark, str(tmp_path)).first()
    assert got.n_scaffolds == len(picked) > 0
    assert got.worst_similarity == pytest.approx(max(picked.values()), abs=1e-6)


def test_medians_by_structure(spark):
    rows = [(1, "OC(=O)[C@H](C)N", "a", "1.0"), (2, "N[C@@H](C)C(=O)O", "b", "3"), (3, "N[C@@H](C)C(=O)O", None, "x"), (4, "broken(", "c", "7"), (5, "broken(", "d", None), (6, None, "e", "2")]
    got = ch.medians_by_structure(spark.createDataFrame(rows, "n long, smiles string, tag string, v string"), "smiles", ["v"], "n").collect()
    assert {(r.smiles, r.n, r.tag, r.v, r.n_rows) for r in got} == {(g.canonical_smiles("N[C@@H](C)C(=O)O"), 1, "a", 2.0, 3), ("broken(", 4, "c", 7.0, 2), (None, 6, "e", 2.0, 1)}


def test_merged_library(spark):
    rows = [("X12", "C", 2, "B", "Lib", 0, 1), ("Ala", "C", 2, "B", "Lib(generated)", 0, 2), ("meZ", "C", 2, "B", "Other", 1, 3), ("Ala", "N", 2, "B", "Other", 1, 4), ("Q", "O", 1, "T", None, 2, 5), ("n", None, 1, "T", "s", 2, 6)]
    got = ch.merged_library(spark.createDataFrame(rows, "symbol string, core string, n_rgroups int, monomer_type string, source string, priority int, entry_id long")).collect()
    assert {(r.core, r.symbol, r.alt_symbols, r.source) for r in got} == {("C", "Ala", "X12;meZ", "Lib(generated)+Other"), ("O", "Q", "", "")}


def test_generated_structures(spark):
    ala, t = "[*:1]N[C@@H](C)C(=O)[*:2]", "symbol string, smiles string"
    table = lambda *rows: spark.createDataFrame(list(rows), t)
    wanted = table(*[(x, None) for x in ("A", "dA", "meA", "Me_dA", "dB", "K", "K", "M", None)])
    got = {r.symbol: (r.smiles, r.origin) for r in ch.generated_structures(wanted, [("first", table(("K", "C"), ("M", None))), ("second", table(("K", "N"), ("M", "O")))], table(("A", ala))).collect()}
    c = g.canonical_smiles
    assert got == {
        "A": (c(ala), "generated"), "dA": (c("[*:1]N[C@H](C)C(=O)[*:2]"), "generated"), "meA": (c("[*:1]N(C)[C@@H](C)C(=O)[*:2]"), "generated"),
        "Me_dA": (c("[*:1]N(C)[C@H](C)C(=O)[*:2]"), "generated"), "dB": (None, "none"), "K": ("C", "first"), "M": ("O", "second"),
    }


def test_pair_features(spark):
    rows = [("CCO", "AAC", "x"), ("CCO", "AAC", "y"), ("broken(", "A", None), ("CC", "", None), (None, "A", None)]
    got = ch.pair_features(spark.createDataFrame(rows, "s string, q string, features string"), "s", "q").collect()
    assert len(got) == 1
    f, bits = got[0].features, g.fingerprint(g.parse("CCO"))
    assert len(f) == 2048 + 21 and [i for i, x in enumerate(f[:2048]) if x] == bits and abs(f[2048] - 2 / 3) < 1e-9 and f[-1] == 3 / 3000
