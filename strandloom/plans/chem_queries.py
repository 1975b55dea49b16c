"""Queries on molecular structure. SQL has no graphs, so most are held against brute force in tests instead."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chemistry as ch
from ..shared import written
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


def _peptides(spark, sf_dir):
    return read(spark, sf_dir, "permeability_peptides").select("row_id", "smiles", F.trim("scaffold").alias("given"), "pampa", "caco2")


@query()
def canonical_structures(spark, sf_dir):
    """Canonical text of each structure; rows whose text can't be read keep null."""
    return ch.canonicalised(_peptides(spark, sf_dir).select("row_id", "smiles"), "smiles", "canonical")


@query("SELECT count(*) AS total, count(smiles) AS parsed, CAST(0 AS BIGINT) AS failed FROM permeability_peptides")
def canonical_statistics(spark, sf_dir):
    """C1's counts: all structures of this table can be read."""
    got = canonical_structures(spark, sf_dir)
    return got.agg(F.count("*").alias("total"), F.count("canonical").alias("parsed"), F.count_if(F.col("smiles").isNotNull() & F.col("canonical").isNull()).alias("failed"))


@query()
def structure_features(spark, sf_dir):
    """R groups, centres, mirror image and N-methylated form of the library's structures."""
    lib = read(spark, sf_dir, "monomer_library").select("monomer_id", "smiles", "n_rgroups")
    return lib.join(ch.structure_features(lib, "smiles"), "smiles", "left")


@query(r"SELECT CAST(count_if(n_rgroups = len(regexp_extract_all(smiles, '\[\*:[0-9]+\]'))) AS BIGINT) AS n_agree, count(*) AS n, CAST(0 AS BIGINT) AS n_stereo_lost FROM monomer_library")
def structure_checks(spark, sf_dir):
    """R groups as declared, and no structure with stereo centres equal to its mirror image."""
    got = structure_features(spark, sf_dir)
    lost = got.where("centres <> '' AND canonical = mirrored")
    n = got.agg(F.count_if(F.col("n_groups") == F.col("n_rgroups")).alias("n_agree"), F.count("*").alias("n"))
    return n.crossJoin(lost.agg(F.count("*").alias("n_stereo_lost")))


@query()
def scaffold_of_peptides(spark, sf_dir):
    """Ring systems and linkers."""
    rows = _peptides(spark, sf_dir)
    return rows.join(ch.scaffolds(rows, "smiles"), "smiles", "left").select("row_id", F.coalesce("scaffold", F.lit(ch.NO_SCAFFOLD)).alias("scaffold"))


@query()
def fingerprint_bits(spark, sf_dir):
    """On-bits of each distinct structure."""
    return ch.fingerprints(_peptides(spark, sf_dir), "smiles").select(F.md5("smiles").alias("key"), F.size("bits").alias("n_bits"), F.array_join("bits", " ").alias("bits"))


def _scaffold_prints(spark, sf_dir):
    """All scaffolds with their rows; no bits for those that can't be read and for rows without a scaffold."""
    rows = _peptides(spark, sf_dir).withColumn("given", F.coalesce(F.nullif("given", F.lit("")), F.lit(ch.NO_SCAFFOLD)))
    sizes = rows.groupBy("given").agg(F.count("*").alias("n"))
    return sizes.join(ch.fingerprints(rows, "given"), "given", "left")


@query()
def scaffold_rarity(spark, sf_dir):
    """How near the next scaffold is; null for a scaffold without fingerprint or if no other has one."""
    prints = written(_scaffold_prints(spark, sf_dir), "prints")
    every = F.array(F.lit(True))
    near = ch.nearest_of(prints, "given", every, every)
    return prints.select("given", "n").join(near.select("given", F.round(F.col("nearest")[0], 6).alias("nearest")), "given", "left")


@query()
def scaffold_novelty(spark, sf_dir):
    """How near the scaffolds of a test set (each fifth by hash) are to train, weighted by rows. A scaffold
    without fingerprint counts as 1, and so does each if train has none."""
    prints = written(_scaffold_prints(spark, sf_dir).withColumn("test", F.conv(F.substring(F.md5("given"), 1, 4), 16, 10).cast("int") % 5 == 0), "prints")
    best = ch.nearest_of(prints, "given", F.array("test"), F.array(~F.col("test"))).select("given", F.col("nearest")[0].alias("similarity"))
    got = prints.where("test").select("given", "n").join(best, "given", "left").withColumn("similarity", F.coalesce("similarity", F.lit(1.0)))
    return got.agg(F.count("*").alias("n_scaffolds"), F.round(F.sum(F.col("similarity") * F.col("n")) / F.sum("n"), 6).alias("mean_similarity"), F.round(F.max("similarity"), 6).alias("worst_similarity"))


@query("SELECT vec_id, CAST(len(v) AS INT) AS size, round(CAST(v[1] AS DOUBLE), 6) AS first, round(CAST(v[100] AS DOUBLE), 6) AS last FROM (SELECT vec_id, (embedding || list_resize(CAST([] AS FLOAT[]), 100, 0))[1:100] AS v FROM embeddings)")
def padded_signatures(spark, sf_dir):
    """Vectors filled up to a fixed size."""
    x = ch.padded_vector(F.col("embedding"), 100)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.size(x).alias("size"), F.round(x[0].cast("double"), 6).alias("first"), F.round(x[99].cast("double"), 6).alias("last"))


def _entries(spark, sf_dir):
    """(symbol, smiles, n_rgroups, monomer_type, source, priority, entry_id) of the library, then of both monomer tables."""
    lib = read(spark, sf_dir, "monomer_library").select("symbol", "smiles", "n_rgroups", "monomer_type", "source", F.lit(0).alias("priority"), F.col("monomer_id").alias("entry_id"))
    chembl = read(spark, sf_dir, "chembl_monomers").select(F.col("monomer_id").alias("symbol"), F.col("monomer_smiles").alias("smiles"), "n_rgroups", "monomer_type", F.lit("ChEMBL").alias("source"), F.lit(1).alias("priority"), F.col("chembl_id").alias("entry_id"))
    cycpept = read(spark, sf_dir, "cycpept_monomers").select("symbol", F.col("cxsmiles").alias("smiles"), "n_rgroups", "monomer_type", F.lit("CycPeptMPDB").alias("source"), F.lit(2).alias("priority"), F.col("cycpept_id").alias("entry_id"))
    return lib.unionByName(chembl).unionByName(cycpept)


@query()
def generated_library(spark, sf_dir):
    """V6: a structure for each symbol of the three tables: ChEMBL's, else CycPept's, else the parent's turned round,
    methylated, or both."""
    entries = _entries(spark, sf_dir)
    of = lambda k: entries.where(F.col("priority") == k).select("symbol", "smiles")
    return ch.generated_structures(entries, [("ChEMBL", of(1)), ("CycPeptMPDB", of(2))], of(0))


@query()
def library_ordered_merge(spark, sf_dir):
    """One entry per canonical structure of three tables, the library first."""
    entries = _entries(spark, sf_dir)
    texts = ch.canonical_texts(entries, "smiles").withColumnRenamed("canonical", "core")
    return ch.merged_library(entries.where("smiles IS NOT NULL").join(texts, "smiles").drop("smiles"))


@query()
def median_by_canonical(spark, sf_dir):
    """A5: medians of the assays per molecule, its first row otherwise."""
    rows = read(spark, sf_dir, "permeability_peptides").select("smiles", "row_id", "id", "source", "permeability", "pampa", "caco2")
    return ch.medians_by_structure(rows, "smiles", ["permeability", "pampa", "caco2"], "row_id")


@query()
def pair_features(spark, sf_dir):
    """Fingerprint and composition of each distinct pair, as the vector's size, sum and number of bits."""
    got = ch.pair_features(read(spark, sf_dir, "ppi_split"), "canonical_smiles", "target_sequence")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return got.select(F.md5("canonical_smiles").alias("smiles_key"), F.md5("target_sequence").alias("sequence_key"), F.size("features").alias("size"), total(F.slice("features", 1, 2048)).cast("int").alias("n_bits"), F.round(total("features"), 6).alias("total"))
