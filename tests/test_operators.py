import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from strandloom.functions import helm as h, stats
from strandloom.operators import curate as c, joins as j, metrics as m, sequences as q, splits as s


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr).first()[0]


@pytest.mark.parametrize(
    "text,want",
    [
        ("PEPTIDE2{A.C}$$$$", "PEPTIDE1{A.C}$$$$"), ("PEPTIDE2{A}|PEPTIDE20{C}$$$$", "PEPTIDE2{A}|PEPTIDE20{C}$$$$"),
        ("PEPTIDE1{A.C.D}$PEPTIDE1,PEPTIDE1,3:R2-1:R1$$$", "PEPTIDE1{A.C.D}$PEPTIDE1,PEPTIDE1,1:R1-3:R2$$$"),
        ("PEPTIDE1{A}$PEPTIDE1,PEPTIDE1,10:R2-9:R1$$$", "PEPTIDE1{A}$PEPTIDE1,PEPTIDE1,9:R1-10:R2$$$"),
        ("PEPTIDE1{A}$PEPTIDE1,PEPTIDE1,?:R1-3:R2$$$", "PEPTIDE1{A}$PEPTIDE1,PEPTIDE1,?:R1-3:R2$$$"), ("CHEM1{x}", "CHEM1{x}"), ("", ""),
    ],
)
def test_normal_helm(spark, text, want):
    assert one(spark, h.linked_in_order(h.renumbered("t")), t=text) == want
    assert one(spark, h.linked_in_order(h.renumbered("t")), t=want) == want


def test_monomers_and_remap(spark):
    assert one(spark, h.monomers("t"), t="PEPTIDE1{[Abu]. A .[meL]..V}|PEPTIDE2{[1].12}$$$$") == ["Abu", "A", "meL", "V", "1", "12"]
    assert one(spark, h.monomers("t"), t="CHEM1{x}$$$$") is None
    table = h.map_column({"X1": "Abu", "Foo": "A", "B": "C"})
    assert one(spark, h.remapped("t", table), t="PEPTIDE1{[X1].X1.[Foo].B}|CHEM1{[X1]}|PEPTIDE2{Foo}$X1$$$") == "PEPTIDE1{[Abu].[Abu].[A].C}|CHEM1{[X1]}|PEPTIDE2{A}$X1$$$"


def test_sequences_to_helm(spark):
    assert one(spark, h.sequence_to_helm("t"), t="acb") == "PEPTIDE1{A.C}$$$$"
    assert [one(spark, h.sequence_to_helm("t"), t=x) for x in ("ACX", "-", " ")] == ["", "", ""]
    assert one(spark, h.design_to_cyclic_helm("t"), t="A.a.MeA.Mea.MeG.Foo") == "PEPTIDE1{A.[dA].[meA].[Me_dA].[Sar].[Foo]}$PEPTIDE1,PEPTIDE1,1:R1-6:R2$$$V2.0"
    assert one(spark, h.sequence_to_smiles("t"), t="GA") == "NCC(=O)N[C@@H](C)C(=O)O"


def test_hot_keys_lose_nothing(spark):
    big = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 40}", i) for i in range(600)], "k string, i int")
    small = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(30)]], "k string, v int")
    hot = j.hot_keys(big, ["k"], 600, 50)
    assert [r.k for r in hot] == ["hot"]
    for how in ("inner", "left"):
        assert sorted(map(str, j.keyed_join(big, small, ["k"], hot, how).collect())) == sorted(map(str, big.join(small, "k", how).collect()))
    assert j.fits(small, 100) and not j.fits(small, 1000, 5000)


def test_deduplicate_and_priority(spark):
    rows = [("h", "s", 10, "a"), ("h", "s", 9, "b"), ("h", None, 1, "c"), ("g", "s", 2, None)]
    got = c.deduplicate(spark.createDataFrame(rows, "helm string, smi string, id int, x string"), ["helm", "smi"], ["id"]).collect()
    assert sorted((r.helm, r.id, r.x, r.source_ids, r.n_rows) for r in got) == [("g", 2, None, "2", 1), ("h", 9, "b", "10;9", 2)]
    p = spark.createDataFrame([("k", "two", 1), ("k", "one", 2), ("k", None, 0), ("l", "other", 5)], "k string, src string, id int")
    assert sorted((r.k, r.id) for r in c.by_priority(p, "k", "src", ["one", "two"], "id").collect()) == [("k", 2), ("l", 5)]


@pytest.mark.parametrize("n", [0, 1, 7, 300])
def test_random_split_sizes(spark, n):
    df = spark.range(n).withColumnRenamed("id", "k")
    got = [r["split"] for r in s.random_split(df, "k", 0.2, "x").collect()]
    assert got.count("test") == -(-n // 5) and len(got) == n


def test_stratified_sizes(spark):
    df = spark.range(103).selectExpr("id AS k", "cast(id % 10 = 0 AS string) AS z")
    got = s.stratified_split(df, "k", "z", 0.1, "x").collect()
    assert len(got) == 103 and sum(r["split"] == "test" for r in got) == 11


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=40), st.integers(2, 6))
def test_folds(sizes, k):
    at = s.balanced_folds([(str(i), n) for i, n in enumerate(sizes)], k)
    load = [sum(n for i, n in enumerate(sizes) if at[str(i)] == f) for f in range(k)]
    assert len(at) == len(sizes) and max(load) - min(load) <= max(sizes)


@pytest.mark.parametrize("per", [1, 4, 100])
def test_negatives(spark, per):
    r = random.Random(1)
    pos = {(f"a{r.randrange(20)}", f"b{r.randrange(15)}") for _ in range(40)}
    got = [tuple(x) for x in s.negative_pairs(spark.createDataFrame(sorted(pos), "a string, b string"), "a", "b", per, "s").collect()]
    free = len({a for a, _ in pos}) * len({b for _, b in pos}) - len(pos)
    assert len(got) == len(set(got)) == min(per * len(pos), free) and not set(got) & pos


def test_running_sum(spark):
    df = spark.createDataFrame([(i * 7 % 50, i) for i in range(50)], "o int, n int")
    want, total = {}, 0
    for r in sorted(df.collect()):
        total += r.n
        want[r.o] = total
    assert {r.o: r.t for r in s.running_sum(df, F.col("n"), [F.col("o")], "t").collect()} == want
    assert s.numbered(df.limit(0), "o").count() == 0


def test_curves_by_brute_force(spark):
    r = random.Random(4)
    rows = [(r.randrange(2), round(r.random(), 1)) for _ in range(80)]
    got = m.curve_areas(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()
    pos, neg = [x for y, x in rows if y], [x for y, x in rows if not y]
    assert abs(got.roc_auc - sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)) < 1e-9
    area, before, prec = 0.0, 0.0, 1.0
    for t in sorted({x for _, x in rows}, reverse=True):
        tp, fp = sum(x >= t for x in pos), sum(x >= t for x in neg)
        area += (tp / len(pos) - before) * (prec + tp / (tp + fp)) / 2
        before, prec = tp / len(pos), tp / (tp + fp)
    assert abs(got.pr_auc - area) < 1e-9
    none = m.curve_areas(spark.createDataFrame([(1, 0.5)], "y int, s double"), "y", "s").first()
    assert none.roc_auc is None and none.pr_auc is None
    assert m.confusion(spark.createDataFrame([], "y int, s double"), "y", F.col("s") > 0.5).first().accuracy == 0.0


def test_special_functions(spark):
    import math

    for x in (0.5, 1.0, 2.5, 30.0, 500.0):
        a, b = spark.range(1).select(stats.lgamma(F.lit(x)), stats.digamma(F.lit(x))).first()
        assert abs(a - math.lgamma(x)) < 1e-8 and abs(b - (math.lgamma(x + 1e-5) - math.lgamma(x - 1e-5)) / 2e-5) < 1e-5


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(5, 40), max_size=60), st.integers(0, 9))
def test_span_masks(body, key):
    ids = [1, *body, 2, 0, 0]
    out, labels = q.masked_spans(ids, key, vocabulary_size=50)
    assert (out, labels) == q.masked_spans(ids, key, vocabulary_size=50)
    chosen = [i for i, x in enumerate(labels) if x != -100]
    assert all(labels[i] == ids[i] and 0 < i <= len(body) for i in chosen) and bool(chosen) == bool(body)
    assert all(out[i] == ids[i] for i in range(len(ids)) if i not in chosen)


def test_pooling(spark):
    from strandloom.operators import vectors as v

    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [0.0, 0.0, 5.0], [1.0, 1.0, 0.0])], "x array<array<double>>, s array<double>, m array<double>")
    a, b = df.select(v.mean_pooled(F.col("x"), F.col("m"), 2), v.attention_pooled(F.col("x"), F.col("s"), F.col("m"), 2)).first()
    assert a == pytest.approx([2, 3]) and b == pytest.approx([2, 3])


def test_nearest_in_blocks(spark):
    from strandloom.operators import vectors as v

    r = random.Random(2)
    e = spark.createDataFrame([(i, [r.random() for _ in range(4)]) for i in range(60)], "k long, x array<double>")
    want = sorted(map(tuple, v.nearest(e.where("k % 5 = 0"), e, "k", "x", 3).collect()))
    assert sorted(map(tuple, v.nearest(e.where("k % 5 = 0"), e, "k", "x", 3, block=4).collect())) == want and len(want) == 36


def plain_greedy(sizes, states, goal, key):
    """Group by group, the top-up over all that is left."""
    add = lambda a, b: tuple(x + y for x, y in zip(a, b))
    test, left, rest, size, state = [], [], sum(sizes), 0, (0, 0, 0)
    for k, n in enumerate(sizes):
        rest -= n
        if (size < goal and size + rest < goal) or (size + n <= goal and key(size + n, add(state, states[k])) < key(size, state)):
            test.append(k)
            size, state = size + n, add(state, states[k])
        else:
            left.append(k)
    while size < goal and left:
        k = left.pop(min(range(len(left)), key=lambda i: key(size + sizes[left[i]], add(state, states[left[i]]))))
        test.append(k)
        size, state = size + sizes[k], add(state, states[k])
    return [k in test for k in range(len(sizes))]


def test_greedy_partition():
    import random

    from strandloom.operators import splits as s

    add = lambda a, b: tuple(x + y for x, y in zip(a, b))
    for seed in range(200):
        r = random.Random(seed)
        states = [tuple(r.choice([0, 0, 1, 2, 9]) for _ in range(3)) for _ in range(r.randrange(1, 40))]
        sizes = [max(1, sum(x)) + r.choice([0, 0, 3, 40]) for x in states]
        total, totals = sum(sizes), tuple(map(sum, zip(*states)))
        goal = round(total * r.choice([0.1, 0.5]))
        key = lambda n, c: s.composition_key(n, c, total, totals, goal)
        assert s.greedy_partition(sizes, states, goal, (0, 0, 0), add, key) == plain_greedy(sizes, states, goal, key)


def test_scaffold_over_the_goal_does_not_end_the_test_set(spark, tmp_path):
    from strandloom.plans import split_queries as q

    rings = ["c1ccccc1"] * 40 + ["C1CC1"] * 7 + [f"C1{'C' * n}C1" for n in range(2, 30) for _ in range(2)] + ["__no_scaffold__", None, " "]
    rows = [(i, "C", x, -5.0, -5.0 if i % 3 else None, -5.0 if i % 4 == 0 else None, "s") for i, x in enumerate(rings)]
    spark.createDataFrame(rows, "row_id long, smiles string, scaffold string, permeability double, pampa double, caco2 double, source string").write.parquet(f"{tmp_path}/permeability_peptides.parquet")
    sizes = {}
    for r in q.scaffold_split_greedy(spark, str(tmp_path)).collect():
        sizes.setdefault(r.strategy, [0, 0])
        sizes[r.strategy][r.in_test] += r.n
    goal = round(len(rings) * 0.1)
    assert len(sizes) == 6 and all(a + b == len(rings) and b >= goal for a, b in sizes.values())
    scores = q.scaffold_split_choice(spark, str(tmp_path)).orderBy("place").collect()
    assert {x.strategy: x.n_test for x in scores} == {k: b for k, (_, b) in sizes.items()} and [x.place for x in scores] == [1, 2, 3, 4, 5, 6]
    assert min((x.gap, x.mean_similarity) for x in scores) == (scores[0].gap, scores[0].mean_similarity)


def test_whole_pools_equal_the_array_operators(spark, small):
    from strandloom.operators import vectors as v
    from strandloom.plans import model_queries as q

    e = spark.read.parquet(f"{small}/embeddings.parquet").withColumn("m", F.when(F.col("vec_id") % 3 != 0, 1.0).otherwise(0.0))
    e = e.select("label", F.struct(F.transform("embedding", lambda x: x.cast("double")).alias("x"), F.col("embedding")[1].cast("double").alias("s"), "m").alias("r"))
    groups = e.groupBy("label").agg(F.collect_list("r").alias("r"))
    want = groups.select("label", v.mean_pooled(F.col("r.x"), F.col("r.m"), 64).alias("a"), v.attention_pooled(F.col("r.x"), F.col("r.s"), F.col("r.m"), 64).alias("b")).collect()
    for name, column, field in (("mean_pool_whole", "mean", "a"), ("attention_pool_whole", "pooled", "b")):
        got = {(r.label, r.dim): r[column] for r in q.QUERIES[name](spark, small).collect()}
        assert got == {(r.label, i): pytest.approx(x, abs=2e-6) for r in want for i, x in enumerate(r[field])} and len(got) == 64 * len(want)


def test_cluster_split_has_a_hundred_clusters(spark, small):
    from strandloom.plans.split_queries import cluster_split

    got = cluster_split(spark, small).groupBy("split").agg(F.count_distinct("cluster").alias("n")).collect()
    assert {r.split: r.n for r in got} == {"test": 20, "train": 80}


def test_size_of_the_library_does_not_change_the_counts(spark, small, monkeypatch):
    from strandloom.plans import helm_queries as q

    want = q.helm_normalize_stats(spark, small).collect()
    monkeypatch.setattr(q, "fits", lambda *_: False)
    assert q.helm_normalize_stats(spark, small).collect() == want


def test_negatives_of_splits(spark):
    """From a split's own ids, no positive of any split, no pair twice; the order of the splits matters."""
    from strandloom.operators import splits

    rows = [(f"c{i % 23}", f"t{i % 7}", "train" if i % 5 else "test") for i in range(60)]
    pos = spark.createDataFrame(sorted(set(rows)), "c string, t string, split string").dropDuplicates(["c", "t"])
    known = {(r.c, r.t) for r in pos.collect()}
    got = splits.split_negatives(pos, "c", "t", "split", ["test", "train"], 2, 7).collect()
    assert len({(r.c, r.t) for r in got}) == len(got) and not known & {(r.c, r.t) for r in got}
    for split in ("train", "test"):
        own = pos.where(f"split = '{split}'").collect()
        cs, ts = {r.c for r in own}, {r.t for r in own}
        mine = [r for r in got if r.split == split]
        assert mine and all(r.c in cs and r.t in ts for r in mine)
    turned = splits.split_negatives(pos, "c", "t", "split", ["train", "test"], 2, 7).collect()
    assert {tuple(r) for r in turned} != {tuple(r) for r in got}


def test_remap_beyond_a_constant_map(spark, small, monkeypatch):
    """A library too large for a constant map gives the same rows by a join."""
    from strandloom.plans import helm_queries

    want = sorted(map(tuple, helm_queries.helm_alt_remap(spark, small).collect()))
    monkeypatch.setattr(helm_queries, "fits", lambda *a, **k: False)
    assert sorted(map(tuple, helm_queries.helm_alt_remap(spark, small).collect())) == want


def test_mlp_against_the_formula(spark):
    from math import erf, sqrt

    from strandloom.operators import vectors

    layer = ([[0.5, -1.0], [2.0, 0.25]], [0.1, -0.3], [1.5, 0.5], [0.0, 0.2])
    rows = [(1, [0.3, -1.2]), (2, [7.0, 0.0])]
    got = {r.k: r.output for r in vectors.mlp(spark.createDataFrame(rows, "k long, x array<double>"), "k", "x", [layer], ([1.0, -2.0], 0.5)).collect()}
    for k, x in rows:
        u = [sum(x[i] * layer[0][i][j] for i in range(2)) + layer[1][j] + x[j] for j in range(2)]
        u = [0.5 * v * (1 + erf(v / sqrt(2))) for v in u]
        mean = sum(u) / 2
        spread = sqrt(sum((v - mean) ** 2 for v in u) / 2 + 1e-5)
        y = [(v - mean) / spread * layer[2][j] + layer[3][j] for j, v in enumerate(u)]
        assert abs(got[k] - (y[0] - 2 * y[1] + 0.5)) < 1e-9


def test_vector_hops(spark):
    from strandloom.operators import vectors

    pairs = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, None, "x")], "row long, c string, t string")
    reps = spark.createDataFrame([("a", "x", 9), ("b", "x", 8)], "c string, t string, rep_id long")
    stored = spark.createDataFrame([(9, [1.0])], "rep_id long, vector array<double>")
    assert sorted((r.row, r.vector[0]) for r in vectors.by_representative(pairs, ["c", "t"], reps, stored).collect()) == [(1, 1.0), (2, 1.0)]
    rows = spark.createDataFrame([("p", [2.0]), ("q", None), ("r", None)], "text string, given array<double>")
    keyed = spark.createDataFrame([("q", [3.0])], "text string, vector array<double>").selectExpr("md5(text) AS key", "vector")
    assert {r.text: r.vector for r in vectors.dispatched(rows, "text", "given", keyed).collect()} == {"p": [2.0], "q": [3.0], "r": None}
