"""Problem 1: splits that keep related records together.

Hash-to-min components over the bipartite graph of keys and what joins them, then weighted rendezvous hashing of
components to splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import is_blank, squeezed, trimmed
from ..operators.joins import hot_keys, keyed_join, lookup_join
from ..shared import keep, written

NO_SCAFFOLD = "__no_scaffold__"
SHARES = {"train": 0.8, "valid": 0.1, "test": 0.1}
#: Salts of the hashing that are tried; the one whose shares come nearest is used.
SALTS = 256


def hash_to_min(edges: DataFrame, hot_rows: int = 50_000) -> DataFrame:
    """Connected components of ``edges`` (src, dst strings): (node, root), root the component's smallest node.

    Each node v holds a cluster C(v), at first itself and its neighbours. A round sends C(v) to its minimum m and m
    to every member; the union of what arrives is the new cluster. At the fixed point the root holds its component
    and every other node the root alone. A cluster is rows of (node, member), never a list in one row, so a giant
    component is spread over tasks; a root with very many members is met by a broadcast of its one row. Every round
    is written to the shared folder and the one before deleted; they go on until a round changes nothing. Empty edges
    give an empty result; self-loops are allowed (a node on its own); edges with a null end are ignored.
    """
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
    both = F.explode(F.array(*[F.struct(F.col(a).alias("node"), F.col(b).alias("member")) for a, b in (("src", "dst"), ("dst", "src"), ("src", "src"), ("dst", "dst"))]))
    state = keep(edges.select(both.alias("p")).select("p.*").distinct(), "clusters")
    seen = None
    while True:
        mark = state.df.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "member")), F.sum(F.xxhash64("member", "node").cast("decimal(20,0)"))).first()
        if mark == seen:
            return written(state.df.groupBy("node").agg(F.min("member").alias("root")), "components", state)
        seen = mark
        least = state.df.groupBy("node").agg(F.min("member").alias("least"))
        met = keyed_join(state.df, least, ["node"], hot_keys(state.df, ["node"], mark[0], hot_rows))
        sent = F.explode(F.array(F.struct(F.col("least").alias("node"), F.col("member").alias("member")), F.struct(F.col("member").alias("node"), F.col("least").alias("member"))))
        after = keep(met.select(sent.alias("p")).select("p.*").distinct(), "clusters")
        state.drop()
        state = after


def _members(ppi: DataFrame, peptides: DataFrame) -> DataFrame:
    """Distinct (key_kind, member, link): link is what may join members, null if nothing does."""
    target = ppi.select(F.lit("target").alias("key_kind"), F.col("target_chembl_id").alias("member"), F.when(~is_blank("protein_class_desc"), F.lower(squeezed("protein_class_desc"))).alias("link")).where(~is_blank("member"))
    scaffold = peptides.select(F.lit("scaffold").alias("key_kind"), trimmed("scaffold").alias("member"), F.when(~is_blank("helm"), trimmed("helm")).alias("link")).where(~is_blank("member") & (F.col("member") != NO_SCAFFOLD))
    return target.unionByName(scaffold).distinct()


def related_keys(ppi: DataFrame, peptides: DataFrame) -> DataFrame:
    """(key_kind, member, group_key) of every key, groups of one included.

    Members are target_chembl_id of ``ppi`` and trimmed scaffold of ``peptides``; null and blank members and
    NO_SCAFFOLD are left out, null and blank links join nothing. Rows are reduced to distinct (member, link) before
    anything is shuffled by key, so a target with a third of the rows weighs no more than any other.
    """
    node = F.concat_ws(":", "key_kind", F.lit("0"), "member")  # sorts before the links of its kind
    link = F.concat_ws(":", "key_kind", F.lit("1"), "link")
    edges = _members(ppi, peptides).select(node.alias("src"), F.when(F.col("link").isNull(), node).otherwise(link).alias("dst"))
    found = hash_to_min(edges)
    kind = F.substring_index("node", ":", 1)
    tail = lambda c: F.expr(f"substring({c}, length(substring_index(node, ':', 1)) + 4)")
    return found.where(F.expr("substring(node, length(substring_index(node, ':', 1)) + 2, 2) = '0:'")).select(kind.alias("key_kind"), tail("node").alias("member"), tail("root").alias("group_key"))


def related_groups(keys: DataFrame) -> DataFrame:
    """Only groups of two or more; the group's smallest member is a row too."""
    others = keys.where(F.col("member") != F.col("group_key"))
    return others.unionByName(others.select("key_kind", F.col("group_key").alias("member"), "group_key").distinct())


def draws(seed: str, salt: Column, key: Column, n: int) -> list[Column]:
    """``n`` (at most 4) numbers in (0, 1) from one MD5 of seed, salt and key."""
    h = F.md5(F.concat_ws(":", F.lit(seed), salt.cast("string"), key))
    return [(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(2**32)) for i in range(n)]


def rendezvous(shares: dict[str, float], seed: str, salt: Column, key: Column) -> Column:
    """The split with the largest -share / ln(u): weighted rendezvous hashing, each split wins its share of keys."""
    live = [(s, float(w)) for s, w in shares.items() if w > 0]
    score = [F.struct((F.lit(-w) / F.log(u)).alias("score"), F.lit(s).alias("split")) for (s, w), u in zip(live, draws(seed, salt, key, len(live)))]
    return (F.greatest(*score) if len(score) > 1 else score[0]).getField("split")


def best_salts(sizes: DataFrame, shares: dict[str, float], seed: str = "split", salts: int = SALTS) -> DataFrame:
    """(table_name, salt): for each table the salt under which hashing all its components comes nearest to the shares.

    ``sizes`` is (table_name, group_key, n). Every component, whatever its size, is placed by rendezvous hashing; only
    the salt is chosen, by the largest gap of any split in rows, ties to the smaller salt. One row per component goes in,
    ``salts`` times the number of splits sums per table come out of the partial aggregation.
    """
    total = sizes.groupBy("table_name").agg(F.sum("n").alias("total"))
    tried = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    tried = tried.withColumn("split", rendezvous(shares, seed, F.col("salt"), F.col("group_key")))
    held = tried.groupBy("table_name", "salt").agg(*[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(f"n_{i}") for i, s in enumerate(shares)])
    gaps = [F.abs(F.col(f"n_{i}") - F.lit(float(w)) * F.col("total")) for i, w in enumerate(shares.values())]
    gap = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    return held.join(F.broadcast(total), "table_name").groupBy("table_name").agg(F.min(F.struct(F.round(gap, 3).alias("gap"), "salt")).alias("best")).select("table_name", F.col("best.salt").alias("salt"))


def assign_splits(ppi: DataFrame, peptides: DataFrame, shares: dict[str, float] | None = None, seed: str = "split", salts: int = SALTS) -> DataFrame:
    """Every row of both tables as (table_name, row_id, group_key, split).

    Rows of one component share a split. A row without a key (null, blank, NO_SCAFFOLD) is a group of its own. At most
    four splits, as one hash gives their draws.
    """
    shares = shares or SHARES
    if len(shares) > 4:
        raise ValueError("at most four splits")
    keys = related_keys(ppi, peptides)
    rows = ppi.select(F.lit("chembl_ppi").alias("table_name"), F.col("row_id"), F.lit("target").alias("key_kind"), F.when(~is_blank("target_chembl_id"), F.col("target_chembl_id")).alias("member")).unionByName(
        peptides.select(F.lit("permeability_peptides").alias("table_name"), F.col("row_id"), F.lit("scaffold").alias("key_kind"), F.when(~is_blank("scaffold") & (trimmed("scaffold") != NO_SCAFFOLD), trimmed("scaffold")).alias("member"))
    )
    alone = rows.where("member IS NULL").select("table_name", "row_id", F.concat_ws(":", F.lit("row"), "table_name", "row_id").alias("group_key"))
    joined = lookup_join(rows.where("member IS NOT NULL"), keys, ["key_kind", "member"], 300).select("table_name", "row_id", F.concat_ws(":", "key_kind", "group_key").alias("group_key"))
    grouped = written(joined.unionByName(alone), "grouped")
    chosen = best_salts(grouped.groupBy("table_name", "group_key").agg(F.count("*").alias("n")), shares, seed, salts)  # two rows
    return grouped.join(F.broadcast(chosen), "table_name").select("table_name", "row_id", "group_key", rendezvous(shares, seed, F.col("salt"), F.col("group_key")).alias("split"))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related_groups(related_keys(_read(spark, sf_dir, "chembl_ppi"), _read(spark, sf_dir, "permeability_peptides")))


def p1_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_splits(_read(spark, sf_dir, "chembl_ppi"), _read(spark, sf_dir, "permeability_peptides"))


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = p1_assignments(spark, sf_dir).groupBy("table_name", "split").agg(F.count("*").alias("n_rows"), F.count_distinct("group_key").alias("n_groups"))
    total = F.sum("n_rows").over(Window.partitionBy("table_name"))
    return got.withColumn("share", F.round(F.col("n_rows") / total, 6))


QUERIES = {"p1_found": p1_found, "p1_assignments": p1_assignments, "p1_shares": p1_shares}
#: White space for DuckDB's regular expressions.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{000B}\x{001C}-\x{001F}]"
_REACH = rf"""
m AS (SELECT DISTINCT 'target' AS key_kind, target_chembl_id AS member, nullif(lower(regexp_replace(protein_class_desc, '{SPACE}', '', 'g')), '') AS link FROM chembl_ppi WHERE trim(target_chembl_id) <> ''
  UNION SELECT DISTINCT 'scaffold', regexp_replace(scaffold, '^{SPACE}+|{SPACE}+$', '', 'g') AS member, nullif(regexp_replace(helm, '^{SPACE}+|{SPACE}+$', '', 'g'), '') FROM permeability_peptides WHERE regexp_replace(scaffold, '{SPACE}', '', 'g') NOT IN ('', '__no_scaffold__')),
e AS (SELECT DISTINCT a.key_kind, a.member AS x, b.member AS y FROM m a JOIN m b ON a.key_kind = b.key_kind AND a.link = b.link AND a.member <> b.member),
reach AS (SELECT key_kind, x, y FROM e UNION SELECT r.key_kind, r.x, e.y FROM reach r JOIN e ON r.key_kind = e.key_kind AND r.y = e.x)"""
_SCORE = lambda i, s: f"row(-{SHARES[s]} / ln((CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) + 0.5) / 4294967296.0), '{s}')"
_SPLIT = f"greatest({', '.join(_SCORE(i, s) for i, s in enumerate(SHARES))})[2]"
_GAP = f"round(greatest({', '.join(f'abs(sum(CASE WHEN split = {chr(39)}{s}{chr(39)} THEN n ELSE 0 END) - {w} * any_value(total))' for s, w in SHARES.items())}), 3)"
_ASSIGNED = rf"""
WITH RECURSIVE {_REACH},
c AS (SELECT key_kind, x AS member, least(x, min(y)) AS root FROM reach GROUP BY 1, 2),
r AS (SELECT 'chembl_ppi' AS table_name, row_id, 'target' AS key_kind, CASE WHEN trim(target_chembl_id) <> '' THEN target_chembl_id END AS member FROM chembl_ppi
  UNION ALL SELECT 'permeability_peptides', row_id, 'scaffold', CASE WHEN regexp_replace(scaffold, '{SPACE}', '', 'g') NOT IN ('', '__no_scaffold__') THEN regexp_replace(scaffold, '^{SPACE}+|{SPACE}+$', '', 'g') END FROM permeability_peptides),
g AS (SELECT table_name, row_id, CASE WHEN r.member IS NULL THEN 'row:' || table_name || ':' || row_id ELSE key_kind || ':' || coalesce(root, r.member) END AS group_key FROM r LEFT JOIN c USING (key_kind, member)),
z AS (SELECT *, sum(n) OVER (PARTITION BY table_name) AS total FROM (SELECT table_name, group_key, count(*) AS n FROM g GROUP BY 1, 2)),
t AS (SELECT table_name, salt, n, total, {_SPLIT} AS split FROM (SELECT *, md5('split:' || salt || ':' || group_key) AS h FROM z, range({SALTS}) s(salt))),
b AS (SELECT table_name, arg_min(salt, row(gap, salt)) AS salt FROM (SELECT table_name, salt, {_GAP} AS gap FROM t GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT table_name, row_id, group_key, {_SPLIT} AS split FROM (SELECT g.*, md5('split:' || salt || ':' || group_key) AS h FROM g JOIN b USING (table_name)))"""
SQL = {
    "p1_found": f"WITH RECURSIVE {_REACH} SELECT key_kind, x AS member, least(x, min(y)) AS group_key FROM reach GROUP BY 1, 2",
    "p1_assignments": f"{_ASSIGNED} SELECT table_name, row_id, group_key, split FROM a",
    "p1_shares": f"{_ASSIGNED} SELECT table_name, split, count(*) AS n_rows, count(DISTINCT group_key) AS n_groups, round(count(*) / sum(count(*)) OVER (PARTITION BY table_name), 6) AS share FROM a GROUP BY 1, 2",
}
