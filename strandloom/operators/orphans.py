"""Problem 7: references to records that do not exist.

Fixpoint cascade: a record whose reference no living record holds is an orphan; so is, indirectly, one whose reference
is held by orphans only. Rounds of semi- and anti-joins go down the foreign-key graph until no orphan is added.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.helm import chain_symbols
from ..functions.text import is_blank, trimmed
from ..shared import written
from .joins import fits, lookup_join

SYMBOL_BYTES = 200


@dataclass
class Reference:
    """``child`` rows (row_id, at, key) refer to ``parent`` records (row_id, key, since, until).

    A parent record holds its key from ``since`` on until before ``until``; null means without end (null since: always).
    ``at`` is the moment the reference must hold; where it is null, only keys no record ever has are orphans.
    """

    child_table: str
    child: DataFrame
    parent_table: str
    parent: DataFrame


def _spans(parent: DataFrame) -> DataFrame:
    """One row for each key: the spans in which records hold it."""
    return parent.where("key IS NOT NULL").groupBy("key").agg(F.collect_set(F.struct("since", "until")).alias("spans"))


def broken(child: DataFrame, parent: DataFrame) -> DataFrame:
    """The rows of ``child`` (at, key and other columns) that ``parent`` does not hold, with their kind: ``missing`` if no
    record ever has the key, else ``deleted`` if one ended at or before ``at``, else ``late``. Null keys refer to nothing."""
    got = lookup_join(child.where("key IS NOT NULL"), _spans(parent), ["key"], SYMBOL_BYTES, "left")
    inside = lambda s: (s["since"].isNull() | (s["since"] <= F.col("at"))) & (s["until"].isNull() | (F.col("at") < s["until"]))
    kind = F.when(F.col("spans").isNull(), "missing").when(F.exists("spans", lambda s: s["until"] <= F.col("at")), "deleted").otherwise("late")
    return got.where(F.col("spans").isNull() | (F.col("at").isNotNull() & ~F.exists("spans", inside))).withColumn("kind", kind).drop("spans")


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orphan_cascade(refs: list[Reference], max_rounds: int | None = None) -> DataFrame:
    """(table_name, row_id, at, key, kind, depth): depth 0 are direct orphans; at depth d the reference is held, but
    only by records that became orphans in round d - 1 or before (kind ``inherited``).

    Each round takes the parent records that died in the round before, finds by semi-join the references to their keys,
    and looks whether a record that is left still holds them; all children of one parent table go together. Tables may
    refer to themselves. The rounds are written to the shared folder. They go on until no orphan is added; a limit, if
    given, is an error when it is reached before.
    """
    columns = ["table_name", "row_id", "at", "key", "kind", "depth"]
    parents = {r.parent_table: r.parent for r in refs}
    children = {p: _together([r.child.select(F.lit(r.child_table).alias("table_name"), "row_id", "at", "key") for r in refs if r.parent_table == p]) for p in parents}
    out = _together([broken(children[p], parents[p]) for p in parents]).withColumn("depth", F.lit(0)).select(columns)
    if not parents.keys() & {r.child_table for r in refs}:
        return out
    out = last = written(out, "orphans")
    depth = 0
    while changed := {r[0] for r in last.where(F.col("table_name").isin(*parents)).select("table_name").distinct().collect()}:
        if depth == max_rounds:
            raise RuntimeError(f"no fixed point after {max_rounds} rounds")
        depth += 1
        more = []
        for p in sorted(changed):
            died, dead = (df.where(F.col("table_name") == p).select("row_id").distinct() for df in (last, out))
            gone = parents[p].join(died, "row_id", "left_semi").where("key IS NOT NULL").select("key").distinct()
            hit = children[p].join(F.broadcast(gone) if fits(gone, SYMBOL_BYTES) else gone, "key", "left_semi")
            known = out.select("table_name", "row_id", "key").distinct()
            new = broken(hit, parents[p].join(dead, "row_id", "left_anti")).join(known, ["table_name", "row_id", "key"], "left_anti")
            more.append(new.withColumn("kind", F.lit("inherited")).withColumn("depth", F.lit(depth)))
        last = written(_together(more).select(columns), "orphans")
        out = out.unionByName(last)
    return out


def library_holdings(library: DataFrame) -> DataFrame:
    """(row_id, key, since, until): each entry of the monomer library holds its symbol and its alternatives."""
    names = F.array_union(F.array(trimmed("symbol")), F.coalesce(F.transform(F.split("alt_symbols", r"[;|]"), trimmed), F.array().cast("array<string>")))
    return library.select(F.col("monomer_id").alias("row_id"), F.explode(names).alias("key"), F.col("added_at").alias("since"), F.col("deleted_at").alias("until")).where(~is_blank("key"))


#: Texts that say that a monomer has no natural analog (fixed values).
NO_ANALOG = ["X", "-"]


def analog_references(library: DataFrame) -> DataFrame:
    """(row_id, at, key): the natural analog an entry refers to, at its added_at; blank and NO_ANALOG refer to nothing."""
    key = trimmed("natural_analog")
    return library.where(~is_blank("natural_analog") & ~key.isin(NO_ANALOG)).select(F.col("monomer_id").alias("row_id"), F.col("added_at").alias("at"), key.alias("key"))


def symbol_references(rows: DataFrame, helm: str) -> DataFrame:
    """(row_id, at, key): the distinct symbols in the PEPTIDE chains of each row, at its loaded_at."""
    return rows.select("row_id", F.col("loaded_at").alias("at"), F.explode(chain_symbols(helm)).alias("key"))


def _references(spark: SparkSession, sf_dir: str) -> list[Reference]:
    """The symbols of both peptide tables, and those of the library itself: an entry whose natural analog is not held
    when it is added is an orphan, and so are, by inheritance, rows whose symbol only such entries hold."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    library = library_holdings(read("monomer_library"))
    return [
        Reference("chembl_ppi", symbol_references(read("chembl_ppi"), "helm_notation"), "monomer_library", library),
        Reference("permeability_peptides", symbol_references(read("permeability_peptides"), "helm"), "monomer_library", library),
        Reference("monomer_library", analog_references(read("monomer_library")), "monomer_library", library),
    ]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade's direct orphans of the two peptide tables; what it adds in later rounds is in p7_report."""
    got = orphan_cascade(_references(spark, sf_dir)).where("kind <> 'inherited' AND table_name <> 'monomer_library'")
    return got.select("table_name", "row_id", F.col("key").alias("symbol"), "kind")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken references per table and month of loaded_at (added_at for the library, created_at for documents; null where
    that is null), direct and inherited.

    Documents refer to targets of chembl_ppi; a target all of whose rows are orphans makes its documents inherit.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    always = F.lit(None).cast("timestamp_ntz")
    targets = read("chembl_ppi").select("row_id", F.col("target_chembl_id").alias("key"), always.alias("since"), always.alias("until"))
    docs = read("documents").select(F.col("doc_id").alias("row_id"), F.col("created_at").alias("at"), F.col("target_chembl_id").alias("key"))
    got = orphan_cascade([*_references(spark, sf_dir), Reference("documents", docs, "chembl_ppi", targets)])
    month = F.date_format("at", "yyyy-MM")
    return got.groupBy("table_name", month.alias("month"), "kind", F.when(F.col("depth") == 0, "direct").otherwise("inherited").alias("origin")).agg(F.count("*").alias("n_references"), F.count_distinct("row_id").alias("n_rows"))


QUERIES = {"p7_found": p7_found, "p7_report": p7_report}
