import random

import numpy as np
import pandas as pd
import pytest

from strandloom.llm import cross_split as c


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near(a, b):
    return a == b or abs(len(a) - len(b)) <= 0.05 * max(len(a), len(b)) and distance(a, b) <= int(0.05 * max(len(a), len(b)) + 1e-9)


def brute(df):
    df = df[df.canonical_smiles.fillna("").str.strip().ne("") & df.target_sequence.fillna("").str.strip().ne("")]
    a, b, memo, out = df[df.split == "train"], df[df.split.isin(["valid", "test"])], {}, set()
    for x in a.itertuples():
        for y in b.itertuples():
            k = (x.target_sequence, y.target_sequence)
            if k not in memo:
                memo[k] = near(*k)
            if memo[k] and near(x.canonical_smiles, y.canonical_smiles):
                out.add((min(x.row_id, y.row_id), max(x.row_id, y.row_id)))
    return out


def test_against_all_pairs(spark, small):
    got = c.p4_found(spark, small).collect()
    assert {tuple(r) for r in got} == brute(pd.read_parquet(f"{small}/ppi_split.parquet")) and len(got) == len(set(got))


def test_report_counts_the_pairs(spark, small):
    rows = {r.row_id: r for r in spark.read.parquet(f"{small}/ppi_split.parquet").collect()}
    want = {}
    for a, b in map(tuple, c.p4_found(spark, small).collect()):
        e = rows[b] if rows[a].split == "train" else rows[a]
        n, s = want.setdefault((e.split, e.source), [0, set()])
        want[e.split, e.source][0] = n + 1
        s.add(e.row_id)
    assert {(r.split, r.source): (r.n_pairs, r.n_rows) for r in c.p4_report(spark, small).collect()} == {k: (n, len(s)) for k, (n, s) in want.items()}


SCHEMA = "row_id long, canonical_smiles string, target_sequence string, split string, source string, family string, q int"


def test_edges(spark):
    r = random.Random(3)
    seq = "".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(200))
    smi = "".join(r.choice("CNO()=c1[]@H") for _ in range(200))
    ten, eleven = list(smi), list(smi)
    for i in range(0, 200, 20):
        ten[i] = "F"
    for i in range(0, 198, 18):
        eleven[i] = "F"
    rows = [
        (1, smi, seq, "train", "s", "x", 1), (2, smi, seq, "test", "s", None, None), (3, "".join(ten), seq[3:], "valid", None, None, None),
        (4, "".join(eleven), seq, "test", "s", None, None), (5, smi, None, "test", "s", None, None), (6, " ", seq, "test", "s", None, None),
        (7, smi, seq, "train", "t", None, None), (8, smi, seq, "holdout", "t", None, None), (9, smi, seq[::-1], "test", "t", None, None),
        (10, "C", "M", "train", "t", None, None), (11, "C", "M", "test", "t", None, None), (12, "N", "M", "test", "t", None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for hot in (50_000, 1):
        pairs, members = c.overlaps(df, hot)
        m = {}
        for x in members.collect():
            m.setdefault((x.record_id, x.q), []).append((x.split, x.row_id))
        got = {(min(i, j), max(i, j)) for p in pairs.collect() for s, i in m[p.record_a, p.q_a] if s == "train" for t, j in m[p.record_b, p.q_b] if t != "train"}
        assert got == {(1, 2), (1, 3), (2, 7), (3, 7), (10, 11)}


def test_empty_and_one_sided(spark):
    for rows in ([], [(1, "C", "M", "train", "s", None, None)]):
        pairs, _ = c.overlaps(spark.createDataFrame(rows, SCHEMA))
        assert pairs.count() == 0


def test_very_long_text():
    t = "ACDEFGHIKL" * 20_000
    assert len(c.shingles(t, 4)) == len(t) - 3 and len(c.bands(t, 4, 10, 3)) == 10
    assert c.jaccard(c.shingles(t, 4), c.shingles(t + "A", 4)) > 0.999


def hard_rows():
    """SMILES with as many edits as allowed, evenly spaced or in the middle of short ones; one family."""
    r, rows = random.Random(11), []
    for n in (19, 20, 21, 22, 25, 40, 41, 60, 100, 161, 240, 498):
        for _ in range(4):
            smi = [r.choice("CNO()=c1[]@H") for _ in range(n)]
            for kind, e in enumerate((n // 20, n // 20 + 1, n // 20)):
                new, gap = list(smi), n / (e + 1)
                for at in range(e, 0, -1):
                    k = round(at * gap)
                    if kind < 2:
                        new[k] = "F"
                    elif at % 2:
                        del new[k]
                    else:
                        new.insert(k, "F")
                rows.append((len(rows), "".join(new), "MKV", "test", "s", None, None))
            rows.append((len(rows), "".join(smi), "MKV", "train", "s", None, None))
    return rows


def found(df):
    pairs, members = c.overlaps(df)
    m = {}
    for x in members.collect():
        m.setdefault((x.record_id, x.q), []).append((x.split, x.row_id))
    return sorted((i, j) for p in pairs.collect() for s, i in m[p.record_a, p.q_a] if s == "train" for t, j in m[p.record_b, p.q_b] if t != "train")


def test_edits_at_the_limit_are_all_found(spark, monkeypatch):
    rows = hard_rows()
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[3] == "train" and b[3] == "test" and near(a[1], b[1]))
    assert len(want) > 80
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == want
    # The same with length classes, parts and slabs.
    monkeypatch.setattr(c, "BLOCK_ROWS", 2)
    monkeypatch.setattr(c, "BLOCK_CHARS", 400)
    assert found(df) == want


def test_slabs_do_not_change_the_pairs(monkeypatch):
    texts = [x[1] for x in hard_rows()]
    whole = [x.tolist() for x in c.close_pairs(texts, texts)]
    monkeypatch.setattr(c, "SLAB", 7)
    assert [x.tolist() for x in c.close_pairs(texts, texts)] == whole


@pytest.mark.parametrize("n", [20, 25, 39, 40, 60, 100, 300])
@pytest.mark.parametrize("spread", ["even", "random", "together"])
def test_bands_find_sequences_at_the_limit(n, spread):
    """As many changes as the definition allows, in every pattern: a common bucket in all but a hundredth of the trials."""
    r, letters = np.random.default_rng(n), np.array(list("ACDEFGHIKLMNPQRSTVWY"))
    edits, found, trials = int(n * c.EDITS + 1e-9), 0, 60
    for _ in range(trials):
        a = r.choice(letters, n)
        at = {"even": (np.arange(edits) + 0.5) * n / edits, "random": r.choice(n, edits, replace=False), "together": np.arange(edits) + n // 2}[spread].astype(int)
        b = a.copy()
        for i in at:
            b[i] = r.choice(letters[letters != a[i]])
        found += bool((c.bands("".join(a), *c.SEQUENCE_LSH) == c.bands("".join(b), *c.SEQUENCE_LSH)).any())
    assert found >= 0.99 * trials


def test_sequences_meet_across_splits_only(spark):
    one, two = "ACDEFGHIKL" * 4, "ACDEFGHIKL" * 3 + "ACDEFGHIKM"
    rows = [("a", one, True, False), ("b", two, True, False), ("c", one[:-1] + "V", False, True)]
    got = c.near_sequences(spark.createDataFrame(rows, "q string, sequence string, in_train boolean, in_eval boolean")).collect()
    assert sorted(map(tuple, got)) == [("a", "c"), ("b", "c")]
