"""Splits, folds, negatives and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chemistry as ch, splits as s
from ..operators.joins import lookup_join
from ..shared import written
from .curate_queries import _CLEAN, _DIM, _POS, assays, positive_pairs, positives_with_attributes
from .helm_queries import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_RANDOM = "WITH o AS (SELECT row_id, row_number() OVER (ORDER BY md5('{seed}:' || row_id)) AS r, count(*) OVER () AS n FROM {table}) SELECT row_id, CASE WHEN r <= {k} THEN 'test' ELSE 'train' END AS split FROM o"


@query(_RANDOM.format(seed="ppi", table="(SELECT row_id FROM chembl_ppi)", k="ceil(0.2 * n)"))
def random_split(spark, sf_dir):
    """Test has ceil(0.2 n) rows."""
    return s.random_split(read(spark, sf_dir, "chembl_ppi").select("row_id"), "row_id", 0.2, "ppi").select("row_id", "split")


@query(f"WITH {_POS}, " + _RANDOM.format(seed="pos", table="pos", k="greatest(1, floor(0.1 * n))")[5:])
def random_split_floor(spark, sf_dir):
    """Positives, test has floor(0.1 n), at least one."""
    return s.random_split(positive_pairs(spark, sf_dir), "row_id", 0.1, "pos", "floor").select("row_id", "split")


_KEY = "CAST(CAST(pampa IS NOT NULL AS INT) AS VARCHAR) || '_' || CAST(CAST(caco2 IS NOT NULL AS INT) AS VARCHAR)"


@query(f"""WITH r AS (SELECT row_id, {_KEY} AS k FROM ({_CLEAN}) WHERE permeability IS NOT NULL), z AS (SELECT k, count(*) AS n FROM r GROUP BY k),
a AS (SELECT k, floor(0.1 * n + 1e-9) AS low, round(0.1 * n - floor(0.1 * n + 1e-9), 9) AS rest, (SELECT count(*) FROM r) AS total FROM z),
b AS (SELECT k, low + CAST(row_number() OVER (ORDER BY rest DESC, k) <= ceil(0.1 * total - 1e-9) - sum(low) OVER () AS INT) AS take FROM a)
SELECT row_id, k AS strat_key, CASE WHEN row_number() OVER (PARTITION BY k ORDER BY md5('strat:' || row_id)) <= take THEN 'test' ELSE 'train' END AS split FROM r JOIN b USING (k)""")
def stratified_split(spark, sf_dir):
    """By availability of assays."""
    key = F.concat_ws("_", *[F.col(x).isNotNull().cast("int").cast("string") for x in ("pampa", "caco2")])
    rows = assays(spark, sf_dir).where("permeability IS NOT NULL").select("row_id", key.alias("strat_key"))
    return s.stratified_split(rows, "row_id", "strat_key", 0.1, "strat").select("row_id", "strat_key", "split")


@query("SELECT row_id, split, CASE WHEN split = 'train' AND row_number() OVER (PARTITION BY split ORDER BY md5('val:' || row_id)) <= ceil(0.1 * count(*) OVER (PARTITION BY split)) THEN 'valid' ELSE split END AS part FROM (SELECT row_id, CASE WHEN split = 'test' THEN 'test' ELSE 'train' END AS split FROM ppi_split)")
def validation_from_train(spark, sf_dir):
    """A tenth of train becomes validation."""
    rows = read(spark, sf_dir, "ppi_split").select("row_id", F.when(F.col("split") == "test", "test").otherwise("train").alias("split"))
    part = s.random_split(rows.where("split = 'train'").select("row_id"), "row_id", 0.1, "val").select("row_id", F.when(F.col("split") == "test", "valid").otherwise("train").alias("part"))
    return rows.join(part, "row_id", "left").withColumn("part", F.coalesce("part", "split"))


@query("SELECT task, split, count(*) AS n, round(avg(v), 6) AS mean FROM (SELECT task, v, CASE WHEN row_number() OVER (PARTITION BY task ORDER BY md5(task || ':' || row_id)) <= ceil(0.1 * count(*) OVER (PARTITION BY task)) THEN 'test' ELSE 'train' END AS split FROM (SELECT row_id, unnest(['pampa', 'caco2']) AS task, unnest([pampa, caco2]) AS v FROM (" + _CLEAN + ")) WHERE v IS NOT NULL) GROUP BY 1, 2")
def split_per_task(spark, sf_dir):
    """Each assay split on its own, with statistics."""
    out = None
    for task in ("pampa", "caco2"):
        rows = assays(spark, sf_dir).where(F.col(task).isNotNull()).select("row_id", F.col(task).alias("v"))
        one = s.random_split(rows, "row_id", 0.1, task).groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean")).withColumn("task", F.lit(task))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT row_id, CAST(row_number() OVER (ORDER BY md5('shuffle:' || row_id)) AS INT) AS place FROM (SELECT row_id FROM ppi_split)")
def seeded_shuffle(spark, sf_dir):
    """A seeded permutation with its places."""
    from ..functions.text import md5_order

    rows = s.numbered(read(spark, sf_dir, "ppi_split").select(md5_order("shuffle", "row_id").alias("o")), "o")
    return read(spark, sf_dir, "ppi_split").select("row_id", md5_order("shuffle", "row_id").alias("o")).join(rows, "o").select("row_id", (F.col("number") + 1).cast("int").alias("place"))


_GROUPS = f"{_POS}, {_DIM}, f AS (SELECT family, target_chembl_id, count(*) AS n FROM pos JOIN d USING (target_chembl_id) GROUP BY 1, 2), g AS (SELECT target_chembl_id, CASE WHEN sum(n) OVER (PARTITION BY family) * 5 > sum(n) OVER () THEN family || '/' || target_chembl_id ELSE family END AS group_id, n FROM f)"


def _groups(spark, sf_dir):
    return s.family_groups(positives_with_attributes(spark, sf_dir), "family", "target_chembl_id", 5)


@query(f"WITH {_GROUPS} SELECT target_chembl_id, group_id, n FROM g")
def family_groups(spark, sf_dir):
    """Families, the large ones by target."""
    return _groups(spark, sf_dir)


@query()
def family_folds(spark, sf_dir):
    """Groups in balanced folds; the test fold."""
    return s.fold_assignment(_groups(spark, sf_dir), 0.2)


@query(f"WITH {_GROUPS} SELECT 0 AS n_split_groups, 5 AS n_folds, CAST(sum(n) AS BIGINT) AS n_rows, true AS balanced FROM g")
def family_fold_checks(spark, sf_dir):
    """V1: no group in two folds, and every fold within 15 % of its share where groups allow it."""
    folds = s.fold_assignment(_groups(spark, sf_dir), 0.2)
    split = folds.groupBy("group_id").agg(F.count_distinct("fold").alias("k")).agg(F.count_if(F.col("k") > 1).cast("int").alias("n_split_groups"))
    load = folds.groupBy("fold").agg(F.sum("n").alias("n"), F.max("n").alias("largest")).agg(F.count("*").cast("int").alias("n_folds"), F.sum("n").alias("n_rows"), (F.max("n") - F.min("n") <= F.greatest(F.max("largest"), F.lit(0.3) * F.avg("n"))).alias("balanced"))
    return split.crossJoin(load)


NEGATIVES = 4


_DRAWN = """a AS (SELECT compound_chembl_id, row_number() OVER (ORDER BY compound_chembl_id) - 1 AS i FROM (SELECT DISTINCT compound_chembl_id FROM {own})), b AS (SELECT target_chembl_id, row_number() OVER (ORDER BY target_chembl_id) - 1 AS j FROM (SELECT DISTINCT target_chembl_id FROM {own})),
w AS (SELECT *, 2 * greatest(1000, 2 * want) >= n_a * n_b AS every FROM (SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, 4 * count(*) AS want FROM {own})),
d AS (SELECT DISTINCT CASE WHEN every THEN id // n_b ELSE CAST('0x' || substr(md5('{seed}:a:' || id), 1, 15) AS BIGINT) % n_a END AS i, CASE WHEN every THEN id % n_b ELSE CAST('0x' || substr(md5('{seed}:b:' || id), 1, 15) AS BIGINT) % n_b END AS j
  FROM (SELECT unnest(range(CASE WHEN every THEN n_a * n_b ELSE greatest(1000, 2 * want) END)) AS id, n_a, n_b, every FROM w)),
f AS (SELECT compound_chembl_id, target_chembl_id FROM d JOIN a USING (i) JOIN b USING (j) ANTI JOIN {known} USING (compound_chembl_id, target_chembl_id)),
o AS (SELECT *, row_number() OVER (ORDER BY md5('{seed}:' || compound_chembl_id || ':' || target_chembl_id)) AS r FROM f)"""


@query(f"WITH {_POS}, {_DRAWN.format(own='pos', known='pos', seed='neg')} SELECT compound_chembl_id, target_chembl_id FROM o, w WHERE r <= want")
def negative_sampling(spark, sf_dir):
    """Four negatives for each positive pair."""
    return s.negative_pairs(positive_pairs(spark, sf_dir), "compound_chembl_id", "target_chembl_id", NEGATIVES, "neg")


def _positive_splits(spark, sf_dir):
    pos = positive_pairs(spark, sf_dir)
    return pos.join(s.random_split(pos.select("row_id"), "row_id", 0.2, "pairs").select("row_id", "split"), "row_id")


_PARTS = f"{_POS}, g AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('pairs:' || row_id)) <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM pos)"
_FIRST = _DRAWN.format(own="(SELECT * FROM g WHERE split = 'train')", known="pos", seed="42")
_THEN = _DRAWN.format(own="(SELECT * FROM g WHERE split = 'test')", known="known", seed="43")
_NEGATIVES = f"""WITH {_PARTS}, n1 AS (WITH {_FIRST} SELECT compound_chembl_id, target_chembl_id FROM o, w WHERE r <= want), known AS (SELECT compound_chembl_id, target_chembl_id FROM pos UNION ALL SELECT * FROM n1),
n2 AS (WITH {_THEN} SELECT compound_chembl_id, target_chembl_id FROM o, w WHERE r <= want), n AS (SELECT *, 'train' AS split FROM n1 UNION ALL SELECT *, 'test' FROM n2)"""


@query(f"{_NEGATIVES} SELECT compound_chembl_id, target_chembl_id, split FROM n")
def negatives_by_split(spark, sf_dir):
    """Four negatives for each positive of a split, from the split's own ids, train first; no positive of any split
    and no pair twice, with a seed for each split."""
    return s.split_negatives(_positive_splits(spark, sf_dir), "compound_chembl_id", "target_chembl_id", "split", ["train", "test"], NEGATIVES, 42)


@query(f"WITH {_POS}, q AS (SELECT count(*) AS p, count(DISTINCT compound_chembl_id) * count(DISTINCT target_chembl_id) AS product FROM pos) SELECT CAST(least(4 * p, product - p) AS BIGINT) AS n_negatives, CAST(0 AS BIGINT) AS n_collisions, CAST(0 AS BIGINT) AS n_repeated FROM q")
def negative_checks(spark, sf_dir):
    """V1-V3: as many negatives as asked for, none a positive, none twice."""
    pos = positive_pairs(spark, sf_dir)
    neg = s.negative_pairs(pos, "compound_chembl_id", "target_chembl_id", NEGATIVES, "neg")
    hit = neg.join(pos.select("compound_chembl_id", "target_chembl_id", F.lit(1).alias("hit")), ["compound_chembl_id", "target_chembl_id"], "left").groupBy("compound_chembl_id", "target_chembl_id").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    return hit.agg(F.sum("n").alias("n_negatives"), F.count_if(F.col("hits") > 0).alias("n_collisions"), F.count_if(F.col("n") > 1).alias("n_repeated"))


@query(f"WITH {_POS}, x AS (SELECT row_id, target_chembl_id, CASE WHEN row_number() OVER (ORDER BY md5('leak:' || row_id)) <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM pos) SELECT CAST(count_if(a AND b) AS BIGINT) AS n_shared_targets, count(*) AS n_targets, round(100.0 * count_if(a AND b) / count(*), 6) AS shared_percent FROM (SELECT bool_or(split = 'train') AS a, bool_or(split = 'test') AS b FROM x GROUP BY target_chembl_id)")
def leakage_report(spark, sf_dir):
    """V2, V3: how many targets a plain random split shares."""
    x = s.random_split(positive_pairs(spark, sf_dir), "row_id", 0.2, "leak").groupBy("target_chembl_id").agg(F.max(F.col("split") == "train").alias("a"), F.max(F.col("split") == "test").alias("b"))
    both = F.count_if(F.col("a") & F.col("b"))
    return x.agg(both.alias("n_shared_targets"), F.count("*").alias("n_targets"), F.round(100.0 * both / F.count("*"), 6).alias("shared_percent"))


_SG = f"sg AS (SELECT coalesce(nullif(scaffold, ''), '__no_scaffold__') AS scaffold, count(*) AS n, count_if(pampa IS NOT NULL AND caco2 IS NOT NULL) AS both_assays FROM ({_CLEAN}) GROUP BY 1)"
_ORD = {"small_first": "n ASC, ", "large_first": "n DESC, ", "two_assays_first": "both_assays DESC, n ASC, ", "seeded": ""}
_ORDERS = " UNION ALL ".join(f"SELECT '{k}' AS strategy, scaffold, n, sum(n) OVER (ORDER BY {o}md5('scaffold:' || scaffold) ROWS UNBOUNDED PRECEDING) AS running FROM sg" for k, o in _ORD.items())


def _scaffold_orders(spark, sf_dir):
    g = assays(spark, sf_dir).groupBy(F.coalesce(F.nullif("scaffold", F.lit("")), F.lit("__no_scaffold__")).alias("scaffold")).agg(F.count("*").alias("n"), F.count_if(F.col("pampa").isNotNull() & F.col("caco2").isNotNull()).alias("both_assays"))
    return s.scaffold_orders(g, 0.1)


@query(f"WITH {_SG}, o AS ({_ORDERS}), t AS (SELECT CAST(round(sum(n) * 0.1) AS BIGINT) AS goal FROM sg) SELECT strategy, scaffold, running <= goal AS in_test FROM o, t")
def scaffold_split_candidates(spark, sf_dir):
    """O1-O3: whole scaffold groups from the front of four orders (the greedy partition is scaffold_split_greedy)."""
    return _scaffold_orders(spark, sf_dir).select("strategy", "scaffold", "in_test")


@query(f"WITH {_SG}, o AS ({_ORDERS}), t AS (SELECT CAST(round(sum(n) * 0.1) AS BIGINT) AS goal FROM sg), z AS (SELECT strategy, CAST(coalesce(sum(n) FILTER (running <= goal), 0) AS BIGINT) AS n_test, max(goal) AS goal, CAST(count_if(running <= goal) AS BIGINT) AS n_groups, coalesce(sum(n) FILTER (running <= goal AND n <= 2), 0) AS tiny FROM o, t GROUP BY 1), y AS (SELECT strategy, n_test, goal, n_groups, round(tiny / greatest(n_test, 1), 6) AS tiny_share, abs(n_test - goal) AS gap FROM z) SELECT *, CAST(row_number() OVER (ORDER BY gap, tiny_share, strategy) AS INT) AS place FROM y")
def scaffold_split_scores(spark, sf_dir):
    """Sizes of the four orders' test sets, the best first (the reference's score is scaffold_split_choice)."""
    return s.scaffold_scores(_scaffold_orders(spark, sf_dir))


def _greedy_orders(spark, sf_dir):
    """(orders, fingerprints of all scaffolds)."""
    rows = assays(spark, sf_dir).withColumn("scaffold", F.coalesce(F.nullif("scaffold", F.lit("")), F.lit(ch.NO_SCAFFOLD)))
    a, b = F.col("pampa").isNotNull(), F.col("caco2").isNotNull()
    groups = rows.groupBy("scaffold").agg(F.count("*").alias("n"), F.min("row_id").alias("first_id"), F.count_if(a & ~b).alias("pampa_only"), F.count_if(b & ~a).alias("caco2_only"), F.count_if(a & b).alias("both"))
    prints = written(ch.fingerprints(groups, "scaffold"), "prints")
    every = F.array(F.lit(True))
    near = ch.nearest_of(prints, "scaffold", every, every).select("scaffold", (1 - F.coalesce(F.col("nearest")[0], F.lit(0.0))).alias("rarity"))
    return written(s.greedy_orders(groups.join(near, "scaffold", "left").fillna(0.0, ["rarity"]), 0.1), "orders"), prints


@query()
def scaffold_split_greedy(spark, sf_dir):
    """Whole scaffold groups in test, by greedy partition of six orders towards size and assay composition."""
    return _greedy_orders(spark, sf_dir)[0].select("strategy", "scaffold", "n", "in_test")


@query()
def scaffold_split_choice(spark, sf_dir):
    """The full score of each of the six; place 1 is the split."""
    got = s.greedy_scores(*_greedy_orders(spark, sf_dir))
    return got.select(*[F.round(c, 6).alias(c) if k == "double" else c for c, k in got.dtypes])


@query()
def scaffold_split(spark, sf_dir):
    """Every peptide in the split that the best of the six greedy partitions gives its scaffold."""
    orders, prints = _greedy_orders(spark, sf_dir)
    best = s.greedy_scores(orders, prints).where("place = 1").select("strategy")
    chosen = orders.join(F.broadcast(best), "strategy").select("scaffold", F.when(F.col("in_test"), "test").otherwise("train").alias("split"))
    rows = assays(spark, sf_dir).select("row_id", F.coalesce(F.nullif("scaffold", F.lit("")), F.lit(ch.NO_SCAFFOLD)).alias("scaffold"))
    return lookup_join(rows, chosen, ["scaffold"], 200).select("row_id", "scaffold", "split")


@query()
def cluster_split(spark, sf_dir):
    """Standardise, PCA, k-means, whole clusters into test."""
    from ..operators.vectors import cluster_split as split

    return split(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=50, clusters=100, ratio=0.2)
