"""Problem 5: best representative of each duplicate group.

Skyline selection: Pareto-undominated records across completeness, recency and trust; a lexicographic policy picks
among them field by field; what is missing is filled from successive dominance layers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import is_blank, trimmed
from ..operators.joins import fits, hot_keys, keyed_join

#: Texts that stand for a missing value, besides null and blank, in any case (fixed values).
MISSING = ["na", "n/a", "none", "-", "?"]
#: The policy of each field: what counts first, second, third. ``more`` is the number of distinct values in a list.
POLICY = {"normalized_smiles": ("trust", "time"), "source_ids": ("more", "trust", "time"), "molecule_type": ("time", "trust")}


def is_missing(c: str) -> Column:
    return is_blank(c) | F.lower(trimmed(c)).isin(MISSING)


def distinct_ids(c: str) -> Column:
    """Number of distinct ids in a ``;`` list, trimmed, empty ones left out."""
    return F.size(F.array_distinct(F.filter(F.transform(F.split(c, ";"), trimmed), lambda x: x != "")))


def scored(records: DataFrame, trust: DataFrame) -> DataFrame:
    """(group_key, record_id, trust, time, and for each field of POLICY its completeness: 0 is missing).

    The trust table is broadcast if it is proven small. Unknown and null sources have trust 0, a null time is the oldest.
    """
    trust = trust.groupBy("source").agg(F.max("trust").alias("trust"))
    rows = records.select(
        trimmed("helm_notation").alias("group_key"), "record_id", "source", F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-(2**62))).alias("time"),
        *[F.when(is_missing(f), 0).otherwise(distinct_ids(f) if "more" in p else F.lit(1)).alias(f) for f, p in POLICY.items()],
    ).where(~is_blank("group_key"))
    rows = rows.join(F.broadcast(trust), "source", "left") if fits(trust, 100) else keyed_join(rows, trust, ["source"], hot_keys(rows, ["source"], rows.count()), "left")
    return rows.withColumn("trust", F.coalesce("trust", F.lit(0))).drop("source")


def cells(rows: DataFrame) -> DataFrame:
    """The newest record (then the smallest id) of each (group, field, completeness, trust).

    All records of a cell but this one are dominated or tied with a larger id, so the skyline lies in the cells. This
    aggregates before the shuffle: a group with a third of all rows comes down to levels of trust times completeness.
    """
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("int").alias("complete")) for f in POLICY]))
    long = rows.select("group_key", "record_id", "trust", "time", fields.alias("f")).select("group_key", "record_id", "trust", "time", "f.*")
    best = F.max(F.struct("time", (-F.col("record_id")).alias("neg"))).alias("best")
    return long.groupBy("group_key", "field", "complete", "trust").agg(best, F.count("*").alias("n"), F.min("record_id").alias("least")).select("group_key", "field", "complete", "trust", F.col("best.time").alias("time"), (-F.col("best.neg")).alias("record_id"), "n", "least")


def layers(points: DataFrame) -> DataFrame:
    """Dominance layers of cells: layer 1 holds what no other cell of the group and field dominates (as large in
    completeness, trust and time, and larger in one), layer k + 1 what only layers up to k dominate.

    A cell's layer is the length of the longest chain of cells that ends in it; a group has one cell per level of
    completeness and trust, so the chains are folded within one row, without a self-join.
    """
    cell = F.struct("complete", "trust", "time", "record_id")
    gathered = points.groupBy("group_key", "field").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.sort_array(F.collect_list(cell), asc=False).alias("cells"))
    done = F.aggregate(
        "cells",
        F.expr("cast(array() as array<struct<complete:int,trust:int,time:bigint,record_id:bigint,layer:int>>)"),
        lambda acc, x: F.concat(
            acc,
            F.array(F.struct(*[x[k].alias(k) for k in ("complete", "trust", "time", "record_id")], (F.coalesce(F.array_max(F.transform(F.filter(acc, lambda y: (y["complete"] >= x["complete"]) & (y["trust"] >= x["trust"]) & (y["time"] >= x["time"])), lambda y: y["layer"])), F.lit(0)) + 1).alias("layer"))),
        ),
    )
    return gathered.select("group_key", "field", "n", "least", F.explode(done).alias("c")).select("group_key", "field", "n", "least", "c.*")


def chosen(layered: DataFrame) -> DataFrame:
    """One row per group of layers(): group_key, group_id, n_records, and the record and layer each field comes from.

    A field is served by the first layer that has a holder of it, where the field's policy picks among the holders of
    that layer only; a layer without a holder leaves the field to the next one. Null if no layer has one.
    """
    first = {"more": F.col("complete"), "trust": F.col("trust"), "time": F.col("time")}
    picks = []
    for f, policy in POLICY.items():
        rank = F.struct((-F.col("layer")).alias("layer"), *[first[p].alias(p) for p in policy], (-F.col("record_id")).alias("neg"))
        picks.append(F.max(F.when((F.col("field") == f) & (F.col("complete") > 0), rank)).alias(f))
    got = layered.groupBy("group_key").agg(F.min("least").alias("group_id"), F.max("n").alias("n_records"), *picks)
    return got.select("group_key", "group_id", "n_records", *[x for f in POLICY for x in ((-F.col(f"{f}.neg")).alias(f"{f}_record"), (-F.col(f"{f}.layer")).alias(f"{f}_layer"))])


def survivors(records: DataFrame, trust: DataFrame) -> DataFrame:
    """One row per group of two or more records: group_id (smallest record_id), group_key, n_records, and for each
    field of POLICY the record_id that gives its value (null if every record lacks it) and the layer it came from.

    Completeness is a dimension of its field's layers, so a holder is dominated by holders only, and the first of any
    lexicographic policy lies on layer 1. Records with null or blank helm_notation belong to no group. Ties end at the
    smallest record_id.
    """
    return chosen(layers(cells(scored(records, trust))).where("n > 1"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = survivors(spark.read.parquet(f"{sf_dir}/compound_records.parquet"), spark.read.parquet(f"{sf_dir}/source_trust.parquet"))
    return got.select("group_id", F.col("normalized_smiles_record").alias("smiles_from"), F.col("source_ids_record").alias("source_ids_from"), F.col("molecule_type_record").alias("type_from"))


def p5_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving records themselves, one per group, with the values."""
    records = spark.read.parquet(f"{sf_dir}/compound_records.parquet")
    got = survivors(records, spark.read.parquet(f"{sf_dir}/source_trust.parquet"))
    for f in POLICY:
        values = records.select(F.col("record_id").alias(f"{f}_record"), trimmed(f).alias(f))
        got = got.join(values, f"{f}_record", "left")
    return got.select("group_id", F.col("group_key").alias("helm_notation"), "n_records", *POLICY)


QUERIES = {"p5_found": p5_found, "p5_survivors": p5_survivors}
_GAP = lambda c: f"({c} IS NULL OR lower(trim({c}, e' \\t\\n')) IN ('', 'na', 'n/a', 'none', '-', '?'))"
_IDS = "len(list_distinct(list_filter(list_transform(string_split(source_ids, ';'), lambda x: trim(x, e' \\t\\n')), lambda x: x <> '')))"
_SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{000B}\x{001C}-\x{001F}]"
_PICKED = f"""
WITH r AS (SELECT trim(helm_notation, e' \\t\\n') AS h, record_id, coalesce(trust, 0) AS t, coalesce(epoch_us(updated_at), -4000000000000000000) AS w, {_GAP('normalized_smiles')} AS no_s, {_GAP('source_ids')} AS no_i, {_GAP('molecule_type')} AS no_m, {_IDS} AS k FROM compound_records LEFT JOIN source_trust USING (source)),
p AS (SELECT h, count(*) AS n, min(record_id) AS group_id, arg_min(record_id, row(-t, -w, record_id)) FILTER (NOT no_s) AS smiles_from, arg_min(record_id, row(-k, -t, -w, record_id)) FILTER (NOT no_i) AS source_ids_from, arg_min(record_id, row(-w, -t, record_id)) FILTER (NOT no_m) AS type_from FROM r WHERE h <> '' GROUP BY h HAVING count(*) > 1)"""
_VALUE = lambda f, c: f"(SELECT regexp_replace({f}, '^{_SPACE}+|{_SPACE}+$', '', 'g') FROM compound_records WHERE record_id = {c}) AS {f}"
SQL = {
    "p5_found": f"{_PICKED} SELECT group_id, smiles_from, source_ids_from, type_from FROM p",
    "p5_survivors": f"{_PICKED} SELECT group_id, h AS helm_notation, n AS n_records, {_VALUE('normalized_smiles', 'smiles_from')}, {_VALUE('source_ids', 'source_ids_from')}, {_VALUE('molecule_type', 'type_from')} FROM p",
}
