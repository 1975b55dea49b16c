import pandas as pd

from strandloom.functions.molgraph import canonical_smiles
from strandloom.llm import monomer_match as m


def test_spelling(spark):
    counts = {"oxa": 400, "aza": 300, "thienyl": 500, "methylidene": 300, "methyl": 350, "dimethyl": 500, "l": 900, "alanine": 900, "chloro": 300, "r3": 200, "oax": 3, "thienyll": 4, "axa": 2, "imethyl": 5, "nm": 4, "n": 600, "oxachloro": 2, "chlroo": 1, "rare": 3, "once": 1}
    got = {r.w: list(r.right) for r in m.spelling(spark.createDataFrame(list(counts.items()), "w string, n long")).collect()}
    want = {w: [w] for w in ("oxa", "aza", "thienyl", "methylidene", "methyl", "dimethyl", "l", "alanine", "chloro", "r3", "rare", "n")}
    want |= {"oax": ["oxa"], "thienyll": ["thienyl"], "chlroo": ["chloro"], "oxachloro": ["oxa", "chloro"]}
    assert got == want  # axa is as near to oxa as to aza, imethyl to methyl as to dimethyl


def test_spelling_does_not_depend_on_the_table_size(spark):
    """Many rows with other words change nothing: a word is judged by its rivals, not by its share."""
    few = [("phenylene", 40), ("phenylenee", 2)]
    more = few + [(f"{a}{b}{a}{b}{a}", 1000) for a in "bcdfg" for b in "hjkl"]
    for words in (few, more):
        got = {r.w: list(r.right) for r in m.spelling(spark.createDataFrame(words, "w string, n long")).collect()}
        assert got["phenylene"] == got["phenylenee"] == ["phenylene"]


def test_names(spark):
    rows = [("L-oxa-chloro-alanine", 30), ("L oxa chlroo alanine", 1), ("compound", 5), ("L-zzz-oxa-alanine", 1), ("", 1)]
    got = {r.name: (list(r.words), r.sure) for r in m.read_names(spark.createDataFrame(rows, "name string, n long")).collect()}
    assert got == {"L-oxa-chloro-alanine": (["l", "oxa", "chloro", "alanine"], True), "L oxa chlroo alanine": (["l", "oxa", "chloro", "alanine"], True), "L-zzz-oxa-alanine": (["l", "zzz", "oxa", "alanine"], False)}


def test_structures_of_equal_monomers_meet(spark, small):
    a, b = pd.read_parquet(f"{small}/cycpept_monomers.parquet"), pd.read_parquet(f"{small}/chembl_monomers.parquet")
    a["k"], b["k"] = a.cxsmiles.map(canonical_smiles), b.monomer_smiles.map(canonical_smiles)
    both = a[a.k.notna()].merge(b[b.k.notna()], on="k")
    got = set(map(tuple, m.p2_found(spark, small).collect()))
    assert set(zip(both.cycpept_id, both.chembl_id)) <= got
    keys = dict(zip(a.cycpept_id, a.k)), dict(zip(b.chembl_id, b.k))
    assert not [p for p in got if isinstance(keys[0][p[0]], str) and isinstance(keys[1][p[1]], str) and keys[0][p[0]] != keys[1][p[1]]]


def test_structures_with_half_their_names_are_cut():
    assert m.read_structure("*N[C@@H](C)C(=O)* |$_R1;_R2$|")[:2] == ("[*:1]N[C@H](C([*:2])=O)C", 2)
    assert m.read_structure("[*:1]N[C@@H](C)C(=O)*") == (None, None, "[*:1]N[C@@H](C)C(=O)*")
    assert m.read_structure(None) == m.read_structure(" |x|") == (None, None, None)
    assert m.contained("N[C@@H](CC1(CC1)C", "[*:1]N[C@@H](CC1(CC1)CSC)C(=O)[*:2]") == 1.0 and m.contained("CC", "CC") is None


def brute_marginals(theta):
    """Exact marginals by adding up all matchings."""
    from math import exp

    pairs = list(theta)
    total, each = 0.0, dict.fromkeys(pairs, 0.0)

    def walk(i, used_a, used_b, weight, chosen):
        nonlocal total
        if i == len(pairs):
            total += weight
            for p in chosen:
                each[p] += weight
            return
        walk(i + 1, used_a, used_b, weight, chosen)
        a, b = pairs[i]
        if a not in used_a and b not in used_b:
            walk(i + 1, used_a | {a}, used_b | {b}, weight * exp(theta[a, b]), [*chosen, (a, b)])

    walk(0, frozenset(), frozenset(), 1.0, [])
    return {p: w / total for p, w in each.items()}


def test_marginals_are_exact_without_loops(spark):
    theta = {("x", "1"): 2.0, ("x", "2"): 1.0, ("y", "2"): 3.0, ("z", "3"): -4.0, ("y", "4"): 0.5}
    got = {(r.a, r.b): r.confidence for r in m.marginals(spark.createDataFrame([(*k, v) for k, v in theta.items()], "a string, b string, theta double")).collect()}
    for p, want in brute_marginals(theta).items():
        assert abs(got[p] - want) < 1e-3


def test_one_to_one_with_loops(spark):
    theta = {("x", "1"): 4.0, ("x", "2"): 1.0, ("y", "1"): 1.0, ("y", "2"): 4.0}
    got = {(r.a, r.b): r.confidence for r in m.marginals(spark.createDataFrame([(*k, v) for k, v in theta.items()], "a string, b string, theta double")).collect()}
    for p, want in brute_marginals(theta).items():
        assert (got[p] > 0.5) == (want > 0.5)


A = "cycpept_id long, symbol string, compound_name string, natural_analog string, cxsmiles string, monomer_type string, n_rgroups int, side string"
B = "chembl_id long, monomer_id string, monomer_name string, natural_analog string, monomer_smiles string, monomer_type string, n_rgroups int, side string"


def test_nulls_repeats_and_clashing_columns(spark):
    ala, dala = "[*:1]N[C@@H](C)C(=O)[*:2]", "[*:1]N[C@H](C)C(=O)[*:2]"
    a = [(1, "A", None, None, ala, None, None, "q"), (2, "A2", " ", None, "*C(=O)[C@H](C)N* |$_R2;_R1$|", "Backbone", 2, None), (3, None, None, None, None, None, None, None), (4, "dA", None, None, dala, "", 2, None)]
    b = [(11, None, None, None, "[R1]N[C@@H](C)C(=O)[R2]", None, None, "q"), (12, None, None, None, "", None, None, None), (13, "A", None, None, "broken(", None, None, None)]
    got = m.match(spark.createDataFrame(a, A), m.CYCPEPT, spark.createDataFrame(b, B), m.CHEMBL)
    assert sorted((r.id_a, r.id_b) for r in got.where("confidence > 0.5").collect()) == [(1, 11), (2, 11)]


def test_empty(spark):
    got = m.match(spark.createDataFrame([], A), m.CYCPEPT, spark.createDataFrame([], B), m.CHEMBL)
    assert got.count() == 0


def test_symbols(spark):
    symbols = ("dYnSu_7", "NMe-DfThDf", "CpPhCa(3)", "Mono99", "X560", None, " ", "YnClOx-92527")
    a = spark.createDataFrame([(i, x, None, None, None, None, None, None) for i, x in enumerate(symbols)], A)
    got = m.features([("a", a, m.CYCPEPT)]).orderBy("id").collect()
    assert [r.symbol for r in got] == ["dynsu", "medfthdf", "cpphca", None, None, None, None, "ynclox"]


def test_messages_decide(spark):
    """Taken alone, three of the four pairs are likelier than not; one-to-one, the strong pairs push the others out."""
    theta = {("x", "1"): 5.0, ("x", "2"): 2.0, ("y", "1"): 2.5, ("y", "3"): 0.2}
    got = {(r.a, r.b): r.confidence for r in m.marginals(spark.createDataFrame([(*k, v) for k, v in theta.items()], "a string, b string, theta double")).collect()}
    assert {p for p, c in got.items() if c > 0.5} == {("x", "1")} and got["y", "3"] > got["y", "1"]
    for p, want in brute_marginals(theta).items():
        assert abs(got[p] - want) < 1e-3


def test_one_to_one_between_records(spark, monkeypatch):
    """A row with a symbol and a cut structure fits two rows; one of them has its partner, so it gets the other. Without
    the messages the table would not tell."""
    whole = "[*:1]N[C@@H](CC(C)(C)CSCC(F)(F)C)C(=O)[*:2]"
    a = [(1, "dAbCd", None, None, whole, "Backbone", 2, None), (2, "dAbCd", None, None, "[*:1]N[C@@H](CC(C)(C)CSCC(F", "Backbone", 2, None)]
    b = [(11, "dAbCd", None, None, whole, "Backbone", 2, None), (12, "dAbCd", None, None, "[*:1]N[C@@H](CC(C)(C)CSCC(F)(F)CC)C(=O)[*:2]", "Backbone", 2, None)]
    rows = lambda: m.match(spark.createDataFrame(a, A), m.CYCPEPT, spark.createDataFrame(b, B), m.CHEMBL).where("confidence > 0.5").collect()
    assert sorted((r.id_a, r.id_b) for r in rows()) == [(1, 11), (2, 12)]
    monkeypatch.setattr(m, "marginals", lambda pairs: pairs.selectExpr("a", "b", "1 / (1 + exp(-theta)) AS confidence"))
    assert sorted((r.id_a, r.id_b) for r in rows()) == [(1, 11), (2, 11), (2, 12)]


def test_messages_settle_without_a_bound(spark):
    pairs = spark.createDataFrame([("a", "x", 2.0), ("a", "y", 1.5), ("b", "x", 1.0), ("b", "y", 1.9), ("c", "y", 19.0), ("c", "x", 18.0)], "a string, b string, theta double")
    assert m.marginals(pairs).count() == 6


def entity_tables(spark, a, b):
    return m.entities(m.features([("a", spark.createDataFrame(a, A), m.CYCPEPT), ("b", spark.createDataFrame(b, B), m.CHEMBL)]))


def test_candidates_do_not_grow_with_the_square_of_a_symbol(spark):
    """All rows share their symbol and the first five words of their name, and none has a structure; only equal names are
    looked at further."""
    units = ("chloro", "ynyl", "difluoro", "carbamoyl")
    names = [f"L-N-methyl-oxa-thia-{x}-{y}-{z}-alanine" for x in units for y in units for z in units]
    a = [(i, "meOxThCl", n, None, None, "Backbone", 2, None) for i, n in enumerate(names)]
    b = [(100 + i, "meOxThCl", n.upper(), None, None, "Backbone", 2, None) for i, n in enumerate(names)]
    assert m.candidates(*entity_tables(spark, a, b)).count() == len(names)
    got = m.match(spark.createDataFrame(a, A), m.CYCPEPT, spark.createDataFrame(b, B), m.CHEMBL).where("confidence > 0.5").collect()
    assert sorted((r.id_a, r.id_b) for r in got) == [(i, 100 + i) for i in range(len(names))]


def test_names_meet_wherever_one_word_differs(spark):
    """The one word stands among the first five as well as the last five."""
    name = lambda w: f"L-oxa-thia-aza-{w}-ynyl-difluoro-carbamoyl-alanine"
    a = [(1, "Mono1", name("zzzqq"), None, None, "Backbone", 2, None)]
    b = [(100, "X1", name("chloro"), None, None, "Backbone", 2, None), (101, "X2", name("zzzqq") + "-amide", None, None, "Backbone", 2, None)]
    got = m.match(spark.createDataFrame(a, A), m.CYCPEPT, spark.createDataFrame(b, B), m.CHEMBL).where("confidence > 0.5").collect()
    assert [(r.id_a, r.id_b) for r in got] == [(1, 100)]


def test_rows_without_a_name_meet_by_symbol(spark):
    """A symbol alone is a weak reason, but one; with another name on either side it is none, and texts not there meet nothing."""
    whole = "[*:1]N[C@@H](CC(C)(C)CSCC(F)(F)C)C(=O)[*:2]"
    a = [(1, "dAbCd", None, None, whole, "Backbone", 2, None), (2, "dAbCd", None, None, None, "Backbone", 2, None), (3, "dAbCd", "D-oxa-thia-alanine", None, None, "Backbone", 2, None), (4, None, None, None, None, None, None, None)]
    b = [(11, "dAbCd", "D-chloro-ynyl-alanine", None, whole, "Backbone", 2, None), (12, "dAbCd", None, None, None, "Backbone", 2, None), (13, None, None, None, None, None, None, None)]
    members, found = entity_tables(spark, a, b)
    of = {r.entity: r.id for r in members.collect()}
    got = {(of[r.a], of[r.b]): r.theta for r in m.candidates(members, found).collect()}
    assert got == {(1, 11): m.LIMIT, (1, 12): -2.0, (2, 11): -2.0, (2, 12): -2.0, (3, 12): -2.0}
