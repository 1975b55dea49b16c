import csv
import io
import re

import pytest
from hypothesis import given, settings, strategies as st

from strandloom.functions.smiles import fault
from strandloom.operators import line_parse as p

GOOD = re.compile(r'(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*')


@settings(max_examples=500, deadline=None)
@given(st.text('a",b ', max_size=25), st.integers(1, 5))
def test_no_quote_edit_is_well_formed(line, width):
    got = p.read_line(line, width)
    assert (got.quotes == 0) == bool(GOOD.fullmatch(line)) and len(got.edits) == got.quotes and len(got.places) == len(got.fields) - 1
    if got.quotes == 0 and line:
        assert got.fields == next(csv.reader(io.StringIO(line, newline=""), strict=True))


@settings(max_examples=300, deadline=None)
@given(st.text('a",', max_size=12), st.integers(1, 4))
def test_quote_edits_give_the_fields(line, width):
    """Doing the edits leaves a well-formed line with the very fields that the path reads."""
    got, mended = p.read_line(line, width), line
    for place, what in reversed(got.edits):
        mended = mended[:place] + ('"' + mended[place:] if what == "insert quote" else mended[place + 1 :])
    assert GOOD.fullmatch(mended)
    if mended:
        assert got.fields == next(csv.reader(io.StringIO(mended, newline=""), strict=True))


def brute_quote_edits(line):
    """Fewest insertions and deletions of quotes that leave a well-formed line."""
    seen, layer, n = {line}, {line}, 0
    while True:
        if any(GOOD.fullmatch(x) for x in layer):
            return n
        n += 1
        layer = {y for x in layer for i in range(len(x) + 1) for y in (x[:i] + '"' + x[i:], x[:i] + x[i + 1 :] if x[i : i + 1] == '"' else x)} - seen
        seen |= layer


@settings(max_examples=150, deadline=None)
@given(st.text('a",', max_size=9))
def test_quote_edits_are_fewest(line):
    assert p.read_line(line, 3).quotes == brute_quote_edits(line)


MONOMER = "A,ala,A,C[C@H](N)C(=O)O,Backbone,2,lib,"


@pytest.mark.parametrize(
    "line,reason",
    [
        (MONOMER, None), (MONOMER + "\r\n", None), (" # note, \"x", "comment"), (MONOMER + ",", "columns"), (MONOMER[:-1], "columns"), ("", "columns"), (None, "columns"),
        (MONOMER.replace("ala", '"a,la"'), None), (MONOMER.replace("ala", '"a""la"'), None), (MONOMER.replace("ala", 'a"la'), "quoting"), (MONOMER.replace("ala", '"ala" '), "quoting"),
        (MONOMER.replace("A,ala", " ,ala"), "value"), (MONOMER.replace("Backbone", "backbone"), "value"), (MONOMER.replace("Backbone", " Backbone\t"), None), (MONOMER.replace(",2,", ",2.0,"), "value"),
        (MONOMER.replace("C[C@H]", "[R1][C@H]"), "value"), (MONOMER.replace("C[C@H](N)C(=O)O", "* |$_R1$|"), None), (MONOMER.replace("C[C@H](N)C(=O)O", " |x|"), "value"),
        ('"' + MONOMER, "quoting"),
    ],
)
def test_reasons_of_monomers(line, reason):
    assert p.judge(line, p.FEEDS["monomer_library"])[0] == reason


def test_reasons_of_compounds():
    feed = p.FEEDS["compound_final"]
    ok = "C1,PEPTIDE1{A}$$$$,C,C,C1;C2,TRUE"
    assert p.judge(ok, feed)[0] is None
    for bad in (ok.replace("C1,P", ",P"), ok.replace("PEPTIDE1{A}$$$$", " "), ok.replace("TRUE", "yes"), ok.replace(",C,C,", ",C,C1CC,")):
        assert p.judge(bad, feed)[0] == "value"
    assert p.judge(ok, None)[0] == "columns" and p.judge('a"b', None)[0] == "quoting"


@pytest.mark.parametrize(
    "text,want",
    [
        ("CC", None), ("c1ccccc1", None), ("[13CH3+]", None), ("[nH]1cccc1", None), ("C%12CC%12", None), ("C(C", "parenthesis"), ("C)C", "parenthesis"), ("C1CC", "ring"), ("[C", "bracket"), ("C]", "bracket"),
        ("[Xx]", "atom"), ("[R1]", "atom"), ("Q", "character"), ("C C", "character"), ("", "blank"), (None, "blank"), (" ", "blank"), ("C |$x$|", None), ("*", None), ("[1*]C", None), ("[*:1]", None), ("[C@@H](N)C", None), ("[Cl-].[Na+]", None),
    ],
)
def test_smiles_faults(text, want):
    assert fault(text) == want


def test_long_broken_line():
    line = "x," * 20_000 + '"'
    got = p.read_line(line, 8)
    assert got.quotes == 1 and len(got.fields) == 8 and got.edits[0][1] == "insert quote"  # one quote put in makes the rest one field
    assert p.judge("x," * 20_000, p.FEEDS["monomer_library"])[0] == "columns"


@pytest.mark.parametrize(
    "line,detail",
    [
        ("A,al,a,A,CC,Backbone,2,lib,", "delete delimiter at 6"),  # not at the end: the types there would not hold
        ("A,ala,A,CC,2,lib,", "insert delimiter at 10; value of monomer_type"),
        ("A,CC,Backbone,2,lib,", "insert delimiter at 1; insert delimiter at 1"),  # an empty name and analog
        ('A,a"la,A,CC,Back,2,lib,', "delete quote at 3; value of monomer_type"),
    ],
)
def test_types_guide_the_edits(line, detail):
    assert p.judge(line, p.FEEDS["monomer_library"])[1] == detail


def test_reasons_come_from_the_cost(monkeypatch):
    """Without the program's quote edits, or without the price of columns, other reasons come out."""
    feed, broken, wide = p.FEEDS["monomer_library"], MONOMER.replace("ala", 'a"la'), MONOMER + ","
    monkeypatch.setattr(p, "read_line", lambda line, width: p.Reading(0, [], line.split(","), [0] * line.count(",")))
    assert p.judge(broken, feed)[0] is None
    monkeypatch.undo()
    monkeypatch.setattr(p, "DELIMITER_COST", 0)
    assert p.judge(wide, feed)[0] is None and p.judge(broken, feed)[0] == "quoting"


def test_long_numbers_are_not_lost(spark):
    lines = [(1, "monomer_library", MONOMER.replace(",2,", "," + "9" * 14 + ",")), (2, "monomer_library", MONOMER.replace(",2,", "," + "9" * 50 + ","))]
    got = p.loaded(p.parse_lines(spark.createDataFrame(lines, "line_id long, feed string, raw_line string")), "monomer_library", p.FEEDS["monomer_library"]).orderBy("line_id").collect()
    assert int(got[0].n_rgroups) == 10**14 - 1 and got[0].unread is None
    assert got[1].n_rgroups is None and got[1].unread == "n_rgroups=" + "9" * 50


def test_tables(spark, small):
    lines = spark.read.parquet(f"{small}/raw_lines.parquet")
    parsed = p.parse_lines(lines).cache()
    comments = lines.where("ltrim(raw_line) LIKE '#%'").count()
    n = sum(p.loaded(parsed, name, feed).count() for name, feed in p.FEEDS.items())
    assert n + p.rejected(parsed).count() + comments == lines.count()
    assert p.parse_lines(lines.limit(0)).count() == 0
    assert dict(p.loaded(parsed, "monomer_library", p.FEEDS["monomer_library"]).dtypes)["n_rgroups"] == "decimal(38,0)"
