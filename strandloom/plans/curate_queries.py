"""Scans, filters, joins, aggregations, deduplication and set operations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import helm as h
from ..operators import curate as c
from ..operators.joins import lookup_join
from .helm_queries import LINKED, WS, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_N = f"n AS (SELECT row_id, compound_chembl_id, CASE WHEN len(list_distinct(regexp_extract_all(helm, 'PEPTIDE[0-9]+'))) = 1 THEN regexp_replace(helm, 'PEPTIDE[0-9]+', 'PEPTIDE1', 'g') ELSE helm END AS helm, smiles FROM (SELECT row_id, compound_chembl_id, nullif(regexp_replace(helm_notation, '{WS}', '', 'g'), '') AS helm, nullif(regexp_replace(normalized_smiles, '{WS}', '', 'g'), '') AS smiles FROM chembl_ppi)), k AS (SELECT row_id, compound_chembl_id, {LINKED} AS helm, smiles FROM n)"


def _normal(spark, sf_dir):
    df = read(spark, sf_dir, "chembl_ppi").select("row_id", "compound_chembl_id", F.nullif(h.clean("helm_notation"), F.lit("")).alias("helm"), F.nullif(h.clean("normalized_smiles"), F.lit("")).alias("smiles"))
    return df.withColumn("helm", h.renumbered("helm")).withColumn("helm", h.linked_in_order("helm"))


@query(f"WITH {_N} SELECT helm, smiles, min(compound_chembl_id) AS compound_chembl_id, array_to_string(list_sort(list(DISTINCT trim(compound_chembl_id))), ';') AS source_ids, count(*) AS n_rows FROM k WHERE helm IS NOT NULL AND smiles IS NOT NULL GROUP BY helm, smiles")
def helm_dedup(spark, sf_dir):
    """Normalised peptides, one row each with provenance."""
    return c.deduplicate(_normal(spark, sf_dir).drop("row_id"), ["helm", "smiles"], ["compound_chembl_id"])


@query(f"WITH {_N} SELECT helm, min(compound_chembl_id) AS compound_chembl_id, min_by(row_id, (compound_chembl_id, row_id)) AS row_id, 'compound_chembl_id=' || array_to_string(list_sort(list(DISTINCT trim(compound_chembl_id))), ';') || '|row_id=' || array_to_string(list_sort(list(DISTINCT CAST(row_id AS VARCHAR))), ';') AS source_ids, count(*) AS n_rows FROM k WHERE helm IS NOT NULL GROUP BY helm")
def helm_dedup_two_ids(spark, sf_dir):
    """A6 with several id columns."""
    return c.deduplicate(_normal(spark, sf_dir).drop("smiles"), ["helm"], ["compound_chembl_id", "row_id"])


@query(f"WITH {_N} SELECT DISTINCT helm, smiles, count(DISTINCT smiles) OVER (PARTITION BY helm) = 1 AS consistent FROM (SELECT DISTINCT helm, smiles FROM k WHERE helm IS NOT NULL AND smiles IS NOT NULL)")
def helm_smiles_consistent(spark, sf_dir):
    """Whether a HELM goes with one structure only."""
    one = _normal(spark, sf_dir).where("helm IS NOT NULL AND smiles IS NOT NULL").select("helm", "smiles").distinct()
    return c.consistent(one, "helm", "smiles").select("helm", "smiles", "consistent")


@query(f"WITH {_N}, g AS (SELECT count(*) AS n FROM k WHERE helm IS NOT NULL AND smiles IS NOT NULL GROUP BY helm, smiles) SELECT max(n) AS largest, round(avg(CASE WHEN n > 1 THEN n END), 6) AS mean_size, CAST(count_if(n > 1) AS BIGINT) AS n_duplicated, round(100.0 * (sum(n) - count(*)) / sum(n), 6) AS removed_percent FROM g")
def dedup_statistics(spark, sf_dir):
    """Sizes of the groups of copies."""
    g = _normal(spark, sf_dir).where("helm IS NOT NULL AND smiles IS NOT NULL").groupBy("helm", "smiles").agg(F.count("*").alias("n"))
    return g.agg(F.max("n").alias("largest"), F.round(F.avg(F.when(F.col("n") > 1, F.col("n"))), 6).alias("mean_size"), F.count_if(F.col("n") > 1).alias("n_duplicated"), F.round(100.0 * (F.sum("n") - F.count("*")) / F.sum("n"), 6).alias("removed_percent"))


@query(f"WITH {_N} SELECT helm, smiles FROM (SELECT helm, smiles, count(*) AS n FROM (SELECT DISTINCT helm, smiles FROM k WHERE helm IS NOT NULL) GROUP BY 1, 2) WHERE n > 1 UNION ALL SELECT 'checked', CAST(count(*) AS VARCHAR) FROM (SELECT DISTINCT helm, smiles FROM k WHERE helm IS NOT NULL AND smiles IS NOT NULL)")
def dedup_leftovers(spark, sf_dir):
    """V5: keys left twice after deduplication (none), with the number checked."""
    d = c.deduplicate(_normal(spark, sf_dir).drop("row_id"), ["helm", "smiles"], ["compound_chembl_id"])
    twice = d.groupBy("helm", "smiles").count().where("count > 1").select("helm", "smiles")
    return twice.unionByName(d.agg(F.lit("checked").alias("helm"), F.count("*").cast("string").alias("smiles")))


SOURCES = ["CycPeptMPDB", "ChEMBL", "CREMP", "Propedia"]
_PRI = "list_position(['CycPeptMPDB', 'ChEMBL', 'CREMP', 'Propedia'], source)"


@query(f"SELECT helm_notation, source, record_id FROM (SELECT helm_notation, source, record_id, row_number() OVER (PARTITION BY helm_notation ORDER BY coalesce(nullif({_PRI}, 0), 5), record_id) AS r FROM (SELECT trim(helm_notation) AS helm_notation, source, record_id FROM compound_records WHERE trim(helm_notation) <> '')) WHERE r = 1")
def priority_dedup(spark, sf_dir):
    """For each molecule the record of the source that comes first."""
    df = read(spark, sf_dir, "compound_records").select(F.trim("helm_notation").alias("helm_notation"), "source", "record_id").where("helm_notation <> ''")
    return c.by_priority(df, "helm_notation", "source", SOURCES, "record_id")


@query("SELECT smiles, min(row_id) AS row_id, round(median(permeability), 9) AS permeability, round(median(pampa), 9) AS pampa, round(median(caco2), 9) AS caco2, count(*) AS n_rows FROM permeability_peptides WHERE smiles IS NOT NULL GROUP BY smiles")
def median_by_structure(spark, sf_dir):
    """Medians of assay values per structure."""
    got = c.medians(read(spark, sf_dir, "permeability_peptides").where("smiles IS NOT NULL").select("smiles", "row_id", "permeability", "pampa", "caco2"), "smiles", ["permeability", "pampa", "caco2"], "row_id")
    return got.select("smiles", "row_id", *[F.round(x, 9).alias(x) for x in ("permeability", "pampa", "caco2")], "n_rows")


@query("SELECT record_id, TRY_CAST(regexp_extract(source_ids, '[0-9]+') AS BIGINT) AS number, TRY_CAST(source_ids AS DOUBLE) AS whole FROM compound_records")
def numeric_coercion(spark, sf_dir):
    """Text that is no number becomes null."""
    return read(spark, sf_dir, "compound_records").select("record_id", F.regexp_extract("source_ids", "[0-9]+", 0).try_cast("bigint").alias("number"), F.col("source_ids").try_cast("double").alias("whole"))


_CLEAN = "SELECT row_id, CASE WHEN permeability > -10 THEN permeability END AS permeability, CASE WHEN pampa > -10 THEN pampa END AS pampa, CASE WHEN caco2 > -10 THEN caco2 END AS caco2, source, trim(scaffold) AS scaffold FROM permeability_peptides"
ASSAYS = ["permeability", "pampa", "caco2"]


def assays(spark, sf_dir):
    df = read(spark, sf_dir, "permeability_peptides")
    return df.select("row_id", *[F.when(F.col(x) > -10, F.col(x)).alias(x) for x in ASSAYS], "source", F.trim("scaffold").alias("scaffold"))


@query(f"SELECT * EXCLUDE (scaffold) FROM ({_CLEAN}) WHERE permeability IS NOT NULL")
def sentinel_filter(spark, sf_dir):
    """sentinels become null; rows without the primary value go."""
    return assays(spark, sf_dir).drop("scaffold").where("permeability IS NOT NULL")


_KEY = "CAST(CAST(pampa IS NOT NULL AS INT) AS VARCHAR) || '_' || CAST(CAST(caco2 IS NOT NULL AS INT) AS VARCHAR)"


@query(f"SELECT {_KEY} AS strat_key, count(*) AS n, round(avg(permeability), 6) AS mean, round(stddev_samp(permeability), 6) AS std, min(permeability) AS lowest, max(permeability) AS highest FROM ({_CLEAN}) WHERE permeability IS NOT NULL GROUP BY 1")
def availability_statistics(spark, sf_dir):
    """Which assays there are, and their values."""
    key = F.concat_ws("_", *[F.col(x).isNotNull().cast("int").cast("string") for x in ("pampa", "caco2")])
    p = F.col("permeability")
    return assays(spark, sf_dir).where("permeability IS NOT NULL").groupBy(key.alias("strat_key")).agg(F.count("*").alias("n"), F.round(F.avg(p), 6).alias("mean"), F.round(F.stddev_samp(p), 6).alias("std"), F.min(p).alias("lowest"), F.max(p).alias("highest"))


_CAT = "CAST(count_if(pampa IS NOT NULL AND caco2 IS NULL) AS BIGINT) AS pampa_only, CAST(count_if(pampa IS NULL AND caco2 IS NOT NULL) AS BIGINT) AS caco2_only, CAST(count_if(pampa IS NOT NULL AND caco2 IS NOT NULL) AS BIGINT) AS both_assays"


@query(f"SELECT scaffold, CAST(grouping(scaffold) AS INT) AS is_total, count(*) AS n, {_CAT} FROM ({_CLEAN}) GROUP BY GROUPING SETS ((scaffold), ())")
def category_counts(spark, sf_dir):
    """A10: assay categories per scaffold and over all, in one pass."""
    a, b = F.col("pampa").isNotNull(), F.col("caco2").isNotNull()
    got = assays(spark, sf_dir).groupingSets([["scaffold"], []], "scaffold").agg(F.grouping("scaffold").cast("int").alias("is_total"), F.count("*").alias("n"), F.count_if(a & ~b).alias("pampa_only"), F.count_if(~a & b).alias("caco2_only"), F.count_if(a & b).alias("both_assays"))
    return got


@query(f"WITH g AS (SELECT scaffold, count(*) AS n FROM ({_CLEAN}) GROUP BY scaffold) SELECT min(n) AS smallest, max(n) AS largest, round(avg(n), 6) AS mean_size, round(stddev_pop(n), 6) AS std_size, round(sum(CASE WHEN n <= 2 THEN n ELSE 0 END) / sum(n), 6) AS tiny_share, round(sum(CASE WHEN scaffold IS NULL OR scaffold IN ('', '__no_scaffold__') THEN n ELSE 0 END) / sum(n), 6) AS none_share FROM g")
def scaffold_group_statistics(spark, sf_dir):
    """Sizes of scaffold groups."""
    g = assays(spark, sf_dir).groupBy("scaffold").agg(F.count("*").alias("n"))
    none = F.col("scaffold").isNull() | F.col("scaffold").isin("", "__no_scaffold__")
    share = lambda x: F.round(F.sum(F.when(x, F.col("n")).otherwise(0)) / F.sum("n"), 6)
    return g.agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("mean_size"), F.round(F.stddev_pop("n"), 6).alias("std_size"), share(F.col("n") <= 2).alias("tiny_share"), share(none).alias("none_share"))


@query("SELECT coalesce(source, 'none') AS source, molecule_type, count(*) AS n FROM (SELECT source, trim(molecule_type) AS molecule_type FROM compound_records WHERE trim(molecule_type) IN ('Protein', 'Small molecule')) GROUP BY 1, 2")
def filtered_reader(spark, sf_dir):
    """Projection, membership filter, rename, counts by source."""
    df = read(spark, sf_dir, "compound_records").select("source", F.trim("molecule_type").alias("kind")).where(F.col("kind").isin("Protein", "Small molecule")).withColumnsRenamed({"kind": "molecule_type"})
    return df.groupBy(F.coalesce("source", F.lit("none")).alias("source"), "molecule_type").agg(F.count("*").alias("n"))


@query(f"SELECT row_id, length(target_sequence) AS n_residues FROM ppi_split WHERE regexp_full_match(upper(target_sequence), '[{h.AMINO_ACIDS}]+') AND NOT contains(canonical_smiles, '.') AND lower(target_name) LIKE '%kinase%'")
def sequence_filters(spark, sf_dir):
    """Alphabet, substring and case-insensitive filters."""
    df = read(spark, sf_dir, "ppi_split")
    return df.where(F.upper("target_sequence").rlike(f"^[{h.AMINO_ACIDS}]+$") & ~F.contains("canonical_smiles", F.lit(".")) & F.ilike("target_name", F.lit("%kinase%"))).select("row_id", F.length("target_sequence").alias("n_residues"))


_POS = "pos AS (SELECT compound_chembl_id, target_chembl_id, min(row_id) AS row_id FROM chembl_ppi WHERE compound_chembl_id IS NOT NULL AND target_chembl_id IS NOT NULL GROUP BY 1, 2 HAVING max(t_1u) = 1)"


def positive_pairs(spark, sf_dir):
    return c.positives(read(spark, sf_dir, "chembl_ppi").select("compound_chembl_id", "target_chembl_id", "t_1u", "row_id"), "compound_chembl_id", "target_chembl_id", "t_1u", "row_id")


@query(f"WITH {_POS} SELECT * FROM pos")
def positive_rows(spark, sf_dir):
    """Active pairs, first row of each."""
    return positive_pairs(spark, sf_dir)


_DIM = "d AS (SELECT target_chembl_id, arg_min(target_accession, row_id) FILTER (target_accession IS NOT NULL) AS accession, coalesce(nullif(trim(arg_min(protein_class_desc, row_id) FILTER (protein_class_desc IS NOT NULL)), ''), 'UNKNOWN') AS family FROM chembl_ppi GROUP BY 1)"


@query(f"WITH {_POS}, {_DIM} SELECT pos.row_id, compound_chembl_id, target_chembl_id, accession, family FROM pos JOIN d USING (target_chembl_id)")
def positives_with_attributes(spark, sf_dir):
    """Pairs with the first known attributes of their target."""
    dim = c.first_known(read(spark, sf_dir, "chembl_ppi").select("target_chembl_id", "target_accession", "protein_class_desc", "row_id"), "target_chembl_id", ["target_accession", "protein_class_desc"], "row_id")
    dim = dim.select("target_chembl_id", F.col("target_accession").alias("accession"), c.family("protein_class_desc").alias("family"))
    return lookup_join(positive_pairs(spark, sf_dir), dim, ["target_chembl_id"], 200).select("row_id", "compound_chembl_id", "target_chembl_id", "accession", "family")


@query(f"WITH {_POS}, r AS (SELECT DISTINCT compound_chembl_id, target_chembl_id FROM chembl_ppi) SELECT CAST((SELECT count(*) FROM r) AS BIGINT) AS n_pairs, CAST((SELECT count(*) FROM r SEMI JOIN pos USING (compound_chembl_id, target_chembl_id)) AS BIGINT) AS n_active, CAST((SELECT count(*) FROM r ANTI JOIN pos USING (compound_chembl_id, target_chembl_id)) AS BIGINT) AS n_inactive")
def registry_anti_join(spark, sf_dir):
    """Pairs in and outside the registry of positives."""
    rows = read(spark, sf_dir, "chembl_ppi").select("compound_chembl_id", "target_chembl_id").distinct()
    known = positive_pairs(spark, sf_dir).select("compound_chembl_id", "target_chembl_id", F.lit(1).alias("hit"))
    return rows.join(known, ["compound_chembl_id", "target_chembl_id"], "left").agg(F.count("*").alias("n_pairs"), F.count("hit").alias("n_active"), F.count_if(F.col("hit").isNull()).alias("n_inactive"))


@query("SELECT split, count(*) AS n FROM (SELECT coalesce(s.split, 'train') AS split FROM (SELECT DISTINCT target_chembl_id FROM chembl_ppi) LEFT JOIN (SELECT target_chembl_id, min(split) AS split FROM ppi_split GROUP BY 1) s USING (target_chembl_id)) GROUP BY 1")
def split_lookup_with_fallback(spark, sf_dir):
    """Targets without a split go to train."""
    known = read(spark, sf_dir, "ppi_split").groupBy("target_chembl_id").agg(F.min("split").alias("split"))
    return read(spark, sf_dir, "chembl_ppi").select("target_chembl_id").distinct().join(known, "target_chembl_id", "left").groupBy(F.coalesce("split", F.lit("train")).alias("split")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT DISTINCT trim(helm_notation) AS helm, trim(canonical_smiles) AS smiles FROM ppi_split WHERE helm_notation IS NOT NULL), c AS (SELECT trim(helm_notation) AS helm, trim(canonical_smiles) AS smiles FROM chembl_ppi)
SELECT count(*) AS n, CAST(count_if(by_helm) AS BIGINT) AS n_by_helm, CAST(count_if(NOT by_helm AND by_smiles) AS BIGINT) AS n_rescued FROM (SELECT helm IN (SELECT helm FROM c WHERE helm IS NOT NULL) AS by_helm, coalesce(smiles IN (SELECT smiles FROM c WHERE smiles IS NOT NULL), false) AS by_smiles FROM r)""")
def coverage(spark, sf_dir):
    """How many peptides a corpus covers by notation, and how many more by structure."""
    rows = read(spark, sf_dir, "ppi_split").where("helm_notation IS NOT NULL").select(F.trim("helm_notation").alias("helm"), F.trim("canonical_smiles").alias("smiles")).distinct()
    corpus = read(spark, sf_dir, "chembl_ppi")
    seen = lambda col, name: corpus.select(F.trim(col).alias(name)).where(F.col(name).isNotNull()).distinct().withColumn(f"has_{name}", F.lit(True))
    got = rows.join(seen("helm_notation", "helm"), "helm", "left").join(seen("canonical_smiles", "smiles"), "smiles", "left")
    return got.agg(F.count("*").alias("n"), F.count_if("has_helm").alias("n_by_helm"), F.count_if(F.col("has_helm").isNull() & F.col("has_smiles")).alias("n_rescued"))


@query("SELECT target_chembl_id, split, count(*) AS n FROM ppi_split p WHERE split = (SELECT s.split FROM (SELECT split, count(*) AS n FROM ppi_split q WHERE q.target_chembl_id = p.target_chembl_id GROUP BY split) s ORDER BY s.n DESC, list_position(['test', 'valid', 'train'], s.split) LIMIT 1) GROUP BY 1, 2")
def majority_prune(spark, sf_dir):
    """Targets stay only in the split that holds most of their rows."""
    df = read(spark, sf_dir, "ppi_split").select("target_chembl_id", "split")
    return c.majority(df, "target_chembl_id", "split", ["test", "valid", "train"]).groupBy("target_chembl_id", "split").agg(F.count("*").alias("n"))


_T = lambda s: f"SELECT DISTINCT target_chembl_id FROM ppi_split WHERE split = '{s}'"


@query(f"SELECT CAST((SELECT count(*) FROM ({_T('train')} INTERSECT {_T('test')})) AS BIGINT) AS n_shared, CAST((SELECT count(*) FROM ({_T('test')} EXCEPT {_T('train')})) AS BIGINT) AS n_test_only, CAST((SELECT count(*) FROM ({_T('train')} UNION {_T('test')})) AS BIGINT) AS n_all")
def split_set_operations(spark, sf_dir):
    """Targets shared between splits, in one only, in any."""
    df = read(spark, sf_dir, "ppi_split").where(F.col("split").isin("train", "test")).groupBy("target_chembl_id").agg(F.max(F.col("split") == "train").alias("a"), F.max(F.col("split") == "test").alias("b"))
    return df.agg(F.count_if(F.col("a") & F.col("b")).alias("n_shared"), F.count_if(F.col("b") & ~F.col("a")).alias("n_test_only"), F.count("*").alias("n_all"))


_C = lambda x: f"regexp_replace({x}, '{WS}', '', 'g')"


@query(f"SELECT helm, min(source) AS source FROM (SELECT {_C('helm_notation')} AS helm, 'ppi' AS source FROM chembl_ppi UNION ALL SELECT {_C('helm')}, 'permeability' FROM permeability_peptides UNION ALL SELECT {_C('helm_notation')}, 'records' FROM compound_records) WHERE length(helm) > 0 GROUP BY helm")
def corpus_union(spark, sf_dir):
    """One corpus from several tables, first source by name."""
    part = lambda t, x, s: read(spark, sf_dir, t).select(h.clean(x).alias("helm"), F.lit(s).alias("source"))
    rows = part("chembl_ppi", "helm_notation", "ppi").unionByName(part("permeability_peptides", "helm", "permeability")).unionByName(part("compound_records", "helm_notation", "records"))
    return rows.where("length(helm) > 0").groupBy("helm").agg(F.min("source").alias("source"))


_LIB = """l AS (SELECT symbol, trim(string_split(smiles, '|')[1]) AS core, n_rgroups, monomer_type, coalesce(source, '') AS source, regexp_matches(symbol, '^(Mono|X)[0-9]+$') AS generic, monomer_id FROM monomer_library),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY monomer_id) AS r FROM l) WHERE r = 1)"""


@query(f"WITH {_LIB} SELECT core, n_rgroups, monomer_type, arg_min(symbol, row(generic, symbol)) AS symbol, array_to_string(list_sort(list(symbol)), ';') AS symbols, array_to_string(list_sort(list(DISTINCT source)), '+') AS source FROM s GROUP BY 1, 2, 3")
def library_merge(spark, sf_dir):
    """Entries of one structure become one; the first symbol (named before generic) leads, all symbols and sources are kept."""
    lib = read(spark, sf_dir, "monomer_library").select("symbol", F.trim(F.split("smiles", r"\|")[0]).alias("core"), "n_rgroups", "monomer_type", F.coalesce("source", F.lit("")).alias("source"), "monomer_id")
    one = c.first_by_key(lib, ["symbol"], ["monomer_id"]).withColumn("generic", F.col("symbol").rlike("^(Mono|X)[0-9]+$"))
    return one.groupBy("core", "n_rgroups", "monomer_type").agg(F.min_by("symbol", F.struct("generic", "symbol")).alias("symbol"), F.array_join(F.sort_array(F.collect_set("symbol")), ";").alias("symbols"), F.array_join(F.sort_array(F.collect_set("source")), "+").alias("source"))


@query(r"SELECT monomer_id, concat_ws(', ', CASE WHEN symbol IS NULL OR symbol = '' THEN 'symbol' END, CASE WHEN smiles IS NULL OR smiles = '' THEN 'smiles' END, CASE WHEN monomer_type NOT IN ('Backbone', 'Terminal', 'Branch', 'Undefined') THEN 'type' END, CASE WHEN n_rgroups <> len(regexp_extract_all(smiles, '\[\*:[0-9]+\]')) THEN 'groups' END, CASE WHEN count(*) OVER (PARTITION BY symbol) > 1 THEN 'collision' END) AS faults FROM monomer_library QUALIFY faults <> ''")
def library_faults(spark, sf_dir):
    """V4: entries that break a rule of the library (an empty result would be a clean one)."""
    lib = read(spark, sf_dir, "monomer_library")
    twice = lib.groupBy("symbol").agg(F.count("*").alias("n"))
    s = F.col
    faults = F.concat_ws(", ", F.when(s("symbol").isNull() | (s("symbol") == ""), "symbol"), F.when(s("smiles").isNull() | (s("smiles") == ""), "smiles"), F.when(~s("monomer_type").isin("Backbone", "Terminal", "Branch", "Undefined"), "type"), F.when(s("n_rgroups") != F.size(F.regexp_extract_all("smiles", F.lit(r"\[\*:[0-9]+\]"), F.lit(0))), "groups"), F.when(s("n") > 1, "collision"))
    return lib.join(twice, "symbol", "left").select("monomer_id", faults.alias("faults")).where("faults <> ''")


@query("SELECT row_id, place, compound_chembl_id FROM (SELECT row_id, compound_chembl_id, CAST(row_number() OVER (ORDER BY standard_value DESC NULLS LAST, row_id) AS INT) AS place FROM chembl_ppi) WHERE place <= 100")
def top_values(spark, sf_dir):
    """O1, O3: the 100 largest values in a total order."""
    top = read(spark, sf_dir, "chembl_ppi").select("row_id", "compound_chembl_id", "standard_value").orderBy(F.desc_nulls_last("standard_value"), "row_id").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("standard_value"), "row_id"))).select("row_id", "place", "compound_chembl_id")
