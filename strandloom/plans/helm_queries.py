"""HELM and monomer queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import helm as h
from ..operators.joins import fits

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ppi(spark, sf_dir):
    return read(spark, sf_dir, "chembl_ppi").select("row_id", "compound_chembl_id", h.clean("helm_notation").alias("helm"))


WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{000B}\x{001C}-\x{001F}]"
PPI = f"p AS (SELECT row_id, compound_chembl_id, regexp_replace(helm_notation, '{WS}', '', 'g') AS helm FROM chembl_ppi)"
_MON = r"list_transform(list_filter(list_transform(flatten(list_transform(regexp_extract_all(helm, 'PEPTIDE[0-9]+\{([^}]*)\}', 1), lambda b: string_split(b, '.'))), lambda m: trim(m)), lambda m: m <> ''), lambda m: regexp_replace(m, '^\[(.*)\]$', '\1'))"
MON = rf"m AS (SELECT row_id, compound_chembl_id, helm, CASE WHEN len(regexp_extract_all(helm, 'PEPTIDE[0-9]+\{{([^}}]*)\}}', 1)) > 0 THEN {_MON} END AS monomers FROM p)"


@query(f"WITH {PPI}, {MON} SELECT row_id, array_to_string(monomers, '.') AS monomers, CAST(len(monomers) AS INT) AS n_monomers FROM m WHERE monomers IS NOT NULL")
def helm_monomers(spark, sf_dir):
    """H1: monomers of every row."""
    m = h.monomers("helm")
    return ppi(spark, sf_dir).select("row_id", F.array_join(m, ".").alias("monomers"), F.when(m.isNotNull(), F.size(m)).alias("n_monomers")).where("monomers IS NOT NULL")


@query(f"WITH {PPI}, {MON} SELECT monomer, count(*) AS n, count(DISTINCT row_id) AS n_rows FROM (SELECT row_id, unnest(monomers) AS monomer FROM m) GROUP BY monomer")
def helm_monomer_rows(spark, sf_dir):
    """One row per monomer, then how often each occurs."""
    return ppi(spark, sf_dir).select("row_id", F.explode(h.monomers("helm")).alias("monomer")).groupBy("monomer").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("n_rows"))


@query(f"WITH {PPI} SELECT CAST(len(list_distinct(regexp_extract_all(helm, 'PEPTIDE[0-9]+'))) AS INT) AS n_chains, count(*) AS n FROM p WHERE helm IS NOT NULL GROUP BY 1")
def helm_chain_counts(spark, sf_dir):
    """H2: number of distinct chains."""
    return ppi(spark, sf_dir).where("helm IS NOT NULL").groupBy(F.size(h.chain_ids("helm")).alias("n_chains")).agg(F.count("*").alias("n"))


@query(f"WITH {PPI} SELECT row_id, CASE WHEN len(list_distinct(regexp_extract_all(replace(helm, 'PEPTIDE1', 'PEPTIDE7'), 'PEPTIDE[0-9]+'))) = 1 THEN regexp_replace(replace(helm, 'PEPTIDE1', 'PEPTIDE7'), 'PEPTIDE[0-9]+', 'PEPTIDE1', 'g') ELSE replace(helm, 'PEPTIDE1', 'PEPTIDE7') END AS helm FROM p WHERE helm IS NOT NULL")
def helm_renumber(spark, sf_dir):
    """H3: single chains become PEPTIDE1 (they are called PEPTIDE7 first, so that there is something to do)."""
    df = ppi(spark, sf_dir).where("helm IS NOT NULL").withColumn("helm", F.replace("helm", F.lit("PEPTIDE1"), F.lit("PEPTIDE7")))
    return df.select("row_id", h.renumbered("helm").alias("helm"))


_L = "^([A-Za-z]+)([0-9]+),([A-Za-z]+)([0-9]+),([0-9]+):R([0-9]+)-([0-9]+):R([0-9]+)$"
_g = lambda x, i: f"regexp_extract({x}, '{_L}', {i})"
_end = lambda x, t, c, p, r: f"row({_g(x, t)}, TRY_CAST({_g(x, c)} AS BIGINT), TRY_CAST({_g(x, p)} AS BIGINT), TRY_CAST({_g(x, r)} AS BIGINT))"
_SWAPPED = lambda x: f"(regexp_matches({x}, '{_L}') AND {_end(x, 3, 4, 7, 8)} < {_end(x, 1, 2, 5, 6)})"
_TURNED = rf"array_to_string(list_transform(string_split(string_split(helm, '$')[2], '|'), lambda x: CASE WHEN {_SWAPPED('x')} THEN regexp_replace(x, '{_L}', '\3\4,\1\2,\7:R\8-\5:R\6') ELSE x END), '|')"
LINKED = f"CASE WHEN len(string_split(helm, '$')) > 2 THEN string_split(helm, '$')[1] || '$' || {_TURNED} || '$' || array_to_string(string_split(helm, '$')[3:], '$') WHEN len(string_split(helm, '$')) = 2 THEN string_split(helm, '$')[1] || '$' || {_TURNED} ELSE helm END"


@query(f"WITH {PPI} SELECT row_id, {LINKED} AS helm FROM p WHERE helm IS NOT NULL")
def helm_connections(spark, sf_dir):
    """H5: connections with their smaller end first."""
    return ppi(spark, sf_dir).where("helm IS NOT NULL").select("row_id", h.linked_in_order("helm").alias("helm"))


@query(f"WITH {PPI}, l AS (SELECT unnest(string_split(string_split(helm, '$')[2], '|')) AS x FROM p WHERE helm LIKE '%$%') SELECT count(*) AS n_links, CAST(count_if({_SWAPPED('x')}) AS BIGINT) AS n_swapped FROM l WHERE x <> ''")
def helm_connection_audit(spark, sf_dir):
    """H9: how many connections are not in order."""
    got = ppi(spark, sf_dir).where(F.col("helm").contains("$")).select(F.explode(h.links("helm")).alias("x")).where("x <> ''")
    return got.agg(F.count("*").alias("n_links"), F.count_if(h.is_swapped(F.col("x"))).alias("n_swapped"))


ALT = "a AS (SELECT alt, min_by(symbol, monomer_id) AS symbol FROM (SELECT monomer_id, symbol, trim(unnest(string_split_regex(alt_symbols, '[;|]'))) AS alt FROM monomer_library) WHERE alt <> '' AND alt <> symbol GROUP BY alt)"


def alternatives(library: DataFrame) -> DataFrame:
    """(alt, symbol) of the library; blanks and maps to itself are left out, the first entry wins."""
    alt = library.select("monomer_id", "symbol", F.explode(F.split("alt_symbols", "[;|]")).alias("alt")).withColumn("alt", F.trim("alt"))
    return alt.where("alt <> '' AND alt <> symbol").groupBy("alt").agg(F.min_by("symbol", "monomer_id").alias("symbol"))


@query(f"WITH {ALT} SELECT alt, symbol FROM a")
def library_alternatives(spark, sf_dir):
    return alternatives(read(spark, sf_dir, "monomer_library"))


def remap(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` (row_id, helm) with the alternatives of ``table`` (alt, symbol) replaced: through a constant map where it is
    proven small, else each row's own symbols are joined and come back as the row's map."""
    if fits(table, 100):
        return rows.withColumn("helm", h.remapped("helm", h.map_column({r["alt"]: r["symbol"] for r in table.collect()})))
    met = rows.select("row_id", F.explode(F.array_distinct(h.monomers("helm"))).alias("alt")).join(table, "alt")
    own = met.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("alt", "symbol"))).alias("_own"))  # the symbols of one row
    got = rows.join(own, "row_id", "left")
    return got.withColumn("helm", F.when(F.col("_own").isNull(), F.col("helm")).otherwise(h.remapped("helm", F.col("_own")))).drop("_own")


@query(
    rf"""WITH {PPI}, {ALT}, t AS (SELECT map(list(alt), list(symbol)) AS t FROM a),
    s AS (SELECT row_id, t, unnest(string_split(helm, '}}')) AS part, generate_subscripts(string_split(helm, '}}'), 1) AS i FROM p, t WHERE helm IS NOT NULL),
    x AS (SELECT row_id, i, CASE WHEN regexp_matches(part, 'PEPTIDE[0-9]+\{{[^{{]*$') THEN regexp_extract(part, '^(.*PEPTIDE[0-9]+\{{)[^{{]*$', 1) || array_to_string(list_transform(string_split(regexp_extract(part, '\{{([^{{]*)$', 1), '.'),
      lambda m: CASE WHEN t[regexp_replace(m, '^\[(.*)\]$', '\1')] IS NULL THEN m WHEN m LIKE '[%' OR length(t[regexp_replace(m, '^\[(.*)\]$', '\1')]) > 1 THEN '[' || t[regexp_replace(m, '^\[(.*)\]$', '\1')] || ']' ELSE t[regexp_replace(m, '^\[(.*)\]$', '\1')] END), '.') ELSE part END AS part FROM s)
    SELECT row_id, string_agg(part, '}}' ORDER BY i) AS helm FROM x GROUP BY row_id"""
)
def helm_alt_remap(spark, sf_dir):
    """H4: alternative symbols replaced by those of the library."""
    return remap(ppi(spark, sf_dir).where("helm IS NOT NULL").select("row_id", "helm"), alternatives(read(spark, sf_dir, "monomer_library")))


@query(f"WITH {PPI}, {MON}, v AS (SELECT list(DISTINCT symbol) AS v FROM monomer_library) SELECT row_id, coalesce(len(list_filter(monomers, lambda x: NOT list_contains(v, x))) = 0, false) AS valid FROM m, v WHERE helm IS NOT NULL")
def helm_validate(spark, sf_dir):
    """H6: whether the library has every monomer; no chain is invalid."""
    symbols = read(spark, sf_dir, "monomer_library").select("symbol").distinct()
    rows = ppi(spark, sf_dir).where("helm IS NOT NULL").select("row_id", h.monomers("helm").alias("monomers"))
    unknown = rows.select("row_id", F.explode("monomers").alias("symbol")).join(F.broadcast(symbols) if fits(symbols, 60) else symbols, "symbol", "left_anti").select("row_id").distinct().withColumn("bad", F.lit(True))
    return rows.join(unknown, "row_id", "left").select("row_id", (F.col("monomers").isNotNull() & F.col("bad").isNull()).alias("valid"))


#: Compound id, token as written, token meant (made up for this query; the last ones are stale).
CORRECTIONS = [("CHEMBL9000000109", "[meA]", "[Sar]"), ("CHEMBL9000000109", "[Sar].G", "G.[Sar]"), ("CHEMBL9000000451", "[dT]", "[dS]"), ("CHEMBL9000000451", "[nowhere]", "A"), ("CHEMBL0", "A", "C")]
_VALUES = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in CORRECTIONS)


def apply_corrections(rows: DataFrame, corrections: list[tuple[str, str, str]]) -> DataFrame:
    """H7: curated rewrites of one compound's tokens, in order, all occurrences."""
    table = rows.sparkSession.createDataFrame([(c, i, a, b) for i, (c, a, b) in enumerate(corrections)], "compound_chembl_id string, i int, original string, corrected string")
    table = table.groupBy("compound_chembl_id").agg(F.sort_array(F.collect_list(F.struct("i", "original", "corrected"))).alias("rewrites"))
    done = F.aggregate("rewrites", F.col("helm"), lambda acc, r: F.replace(acc, r["original"], r["corrected"]))
    table = F.broadcast(table) if fits(table, 200) else table
    return rows.join(table, "compound_chembl_id", "left").withColumn("helm", F.when(F.col("rewrites").isNull(), F.col("helm")).otherwise(done)).drop("rewrites")


@query(f"WITH {PPI} SELECT row_id, CASE compound_chembl_id WHEN 'CHEMBL9000000109' THEN replace(replace(helm, '[meA]', '[Sar]'), '[Sar].G', 'G.[Sar]') WHEN 'CHEMBL9000000451' THEN replace(replace(helm, '[dT]', '[dS]'), '[nowhere]', 'A') ELSE helm END AS helm FROM p WHERE helm IS NOT NULL")
def helm_corrections(spark, sf_dir):
    return apply_corrections(ppi(spark, sf_dir).where("helm IS NOT NULL"), CORRECTIONS).select("row_id", "helm")


@query(f"WITH {PPI}, c(id, token, corrected) AS (VALUES {_VALUES}) SELECT id AS compound_chembl_id, token, count(helm) AS n_rows, CAST(coalesce(count_if(contains(helm, token)), 0) AS BIGINT) AS n_hits FROM c LEFT JOIN p ON id = compound_chembl_id GROUP BY 1, 2")
def helm_stale_corrections(spark, sf_dir):
    """H7's audit: rewrites whose compound or token no row has."""
    c = spark.createDataFrame(CORRECTIONS, "compound_chembl_id string, token string, corrected string")
    few = ppi(spark, sf_dir).join(F.broadcast(c.select("compound_chembl_id").distinct()), "compound_chembl_id", "left_semi").select("compound_chembl_id", "helm")
    got = c.join(few, "compound_chembl_id", "left")
    return got.groupBy("compound_chembl_id", "token").agg(F.count("helm").alias("n_rows"), F.count_if(F.contains("helm", "token")).alias("n_hits"))


@query(
    f"""WITH {PPI}, {MON}, v AS (SELECT list(DISTINCT symbol) AS v FROM monomer_library)
    SELECT count(*) AS total, CAST(count_if(helm IS NULL OR helm = '') AS BIGINT) AS n_blank, CAST(count_if(helm <> '' AND len(list_distinct(regexp_extract_all(helm, 'PEPTIDE[0-9]+'))) = 1 AND NOT contains(helm, 'PEPTIDE1')) AS BIGINT) AS n_renumbered,
    CAST(count_if(helm <> {LINKED}) AS BIGINT) AS n_reordered, CAST(count_if(helm <> '' AND monomers IS NULL) AS BIGINT) AS n_no_chain, CAST(count_if(coalesce(len(list_filter(monomers, lambda x: NOT list_contains(v, x))) > 0, false)) AS BIGINT) AS n_unknown, CAST(sum(coalesce(len(monomers), 0)) AS BIGINT) AS n_monomers FROM m, v"""
)
def helm_normalize_stats(spark, sf_dir):
    """H8: what normalisation does, as one row of counts."""
    library = read(spark, sf_dir, "monomer_library").select("symbol").distinct()
    df = ppi(spark, sf_dir).withColumn("monomers", h.monomers("helm"))
    symbols = df.select("row_id", F.explode("monomers").alias("symbol"))
    unknown = symbols.join(F.broadcast(library) if fits(library, 60) else library, "symbol", "left_anti").agg(F.count_distinct("row_id").alias("n_unknown"))
    counts = df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("helm").isNull() | (F.col("helm") == "")).alias("n_blank"),
        F.count_if((F.col("helm") != "") & (F.size(h.chain_ids("helm")) == 1) & ~F.col("helm").contains("PEPTIDE1")).alias("n_renumbered"),
        F.count_if(F.col("helm") != h.linked_in_order("helm")).alias("n_reordered"),
        F.count_if((F.col("helm") != "") & F.col("monomers").isNull()).alias("n_no_chain"),
        F.sum(F.coalesce(F.when(F.col("monomers").isNotNull(), F.size("monomers")), F.lit(0))).alias("n_monomers"),
    )
    return counts.crossJoin(unknown).select("total", "n_blank", "n_renumbered", "n_reordered", "n_no_chain", "n_unknown", "n_monomers")


_SEQ = f"upper(trim(target_sequence)) AS up, regexp_replace(upper(trim(target_sequence)), '[^{h.AMINO_ACIDS}]', '', 'g') AS kept"
SEQ = f"q AS (SELECT row_id, CASE WHEN up <> '' AND up <> '-' AND NOT contains(up, 'X') AND kept <> '' THEN kept END AS s FROM (SELECT row_id, {_SEQ} FROM ppi_split))"


@query(f"WITH {SEQ} SELECT row_id, coalesce('PEPTIDE1{{' || array_to_string(string_split(s, ''), '.') || '}}$$$$', '') AS helm FROM q")
def sequence_to_helm(spark, sf_dir):
    """Linear sequences as HELM."""
    return read(spark, sf_dir, "ppi_split").select("row_id", h.sequence_to_helm("target_sequence").alias("helm"))


_RES = "map([" + ", ".join(f"'{k}'" for k in h.RESIDUES) + "], [" + ", ".join(f"'{v}'" for v in h.RESIDUES.values()) + "])"


@query(f"WITH {SEQ} SELECT row_id, md5(coalesce(array_to_string(list_transform(string_split(s, ''), lambda a: {_RES}[a]), '') || 'O', '')) AS smiles_md5 FROM q")
def sequence_to_smiles(spark, sf_dir):
    """Linear sequences as SMILES (their hash, as they are long)."""
    return read(spark, sf_dir, "ppi_split").select("row_id", F.md5(h.sequence_to_smiles("target_sequence")).alias("smiles_md5"))


_DM = "CASE WHEN m = 'MeG' THEN '[Sar]' WHEN regexp_full_match(m, '[A-Z]') THEN m WHEN regexp_full_match(m, '[a-z]') THEN '[d' || upper(m) || ']' WHEN regexp_full_match(m, 'Me[A-Z]') THEN '[me' || m[3] || ']' WHEN regexp_full_match(m, 'Me[a-z]') THEN '[Me_d' || upper(m[3]) || ']' ELSE '[' || m || ']' END"


@query(
    f"""WITH {PPI}, {MON}, d AS (SELECT row_id, list_transform(monomers, lambda m: CASE WHEN regexp_full_match(m, 'me[A-Z]') THEN 'M' || m[2:] WHEN regexp_full_match(m, 'd[A-Z]') THEN lower(m[2]) WHEN m = 'meV' THEN 'MeG' ELSE m END) AS c FROM m WHERE len(monomers) > 0)
    SELECT row_id, 'PEPTIDE1{{' || array_to_string(list_transform(c, lambda m: {_DM}), '.') || '}}$PEPTIDE1,PEPTIDE1,1:R1-' || len(c) || ':R2$$$V2.0' AS helm FROM d"""
)
def design_to_cyclic_helm(spark, sf_dir):
    """Design codes (written from the monomers of each row) as cyclic HELM."""
    m = h.monomers("helm")
    code = F.transform(m, lambda x: F.when(x.rlike("^me[A-Z]$"), F.concat(F.lit("M"), F.substring(x, 2, 9))).when(x.rlike("^d[A-Z]$"), F.lower(F.substring(x, 2, 1))).otherwise(x))
    return ppi(spark, sf_dir).where(F.size(m) > 0).select("row_id", h.design_to_cyclic_helm(F.array_join(code, ".")).alias("helm"))


@query(
    "SELECT md5(target_sequence) AS sequence_key, "
    + ", ".join(f"round((length(target_sequence) - length(replace(target_sequence, '{a}', ''))) / length(target_sequence), 6) AS share_{a.lower()}" for a in h.AMINO_ACIDS)
    + ", round(least(length(target_sequence), 3000) / 3000, 6) AS length_share FROM (SELECT DISTINCT target_sequence FROM chembl_ppi WHERE target_sequence <> '')"
)
def sequence_composition(spark, sf_dir):
    """Residue shares of each distinct sequence under its content key."""
    one = read(spark, sf_dir, "chembl_ppi").where("target_sequence <> ''").select("target_sequence").distinct()
    names = [f"share_{a.lower()}" for a in h.AMINO_ACIDS] + ["length_share"]
    return one.select(F.md5("target_sequence").alias("sequence_key"), *[F.round(c, 6).alias(n) for n, c in zip(names, h.composition("target_sequence"))])


@query(
    r"""SELECT monomer_id, upper(trim(symbol)) AS key, regexp_matches(symbol, '^(Mono|X)[0-9]+$') AS is_generic, trim(string_split(smiles, '|')[1]) AS core, CAST(len(regexp_extract_all(smiles, '\[\*:[0-9]+\]')) AS INT) AS n_groups,
    regexp_extract(symbol, '^(?:Me_d|me|d)?([A-Z])$', 1) AS base, CASE WHEN symbol LIKE 'Me_d%' THEN 'D, N-methyl' WHEN symbol LIKE 'me%' THEN 'N-methyl' WHEN symbol LIKE 'd%' THEN 'D' ELSE 'L' END AS description FROM monomer_library"""
)
def monomer_features(spark, sf_dir):
    """What symbol and structure text of a library entry say."""
    lib = read(spark, sf_dir, "monomer_library")
    s = F.col("symbol")
    return lib.select(
        "monomer_id", F.upper(F.trim(s)).alias("key"), s.rlike("^(Mono|X)[0-9]+$").alias("is_generic"), F.trim(F.split("smiles", r"\|")[0]).alias("core"), F.size(F.regexp_extract_all("smiles", F.lit(r"\[\*:[0-9]+\]"), F.lit(0))).alias("n_groups"),
        F.regexp_extract(s, "^(?:Me_d|me|d)?([A-Z])$", 1).alias("base"), F.when(s.startswith("Me_d"), "D, N-methyl").when(s.startswith("me"), "N-methyl").when(s.startswith("d"), "D").otherwise("L").alias("description"),
    )


_REMAP = rf"""t AS (SELECT map(list(alt), list(symbol)) AS t FROM a),
    s AS (SELECT row_id, t, unnest(string_split(helm, '}}')) AS part, generate_subscripts(string_split(helm, '}}'), 1) AS i FROM n, t),
    x AS (SELECT row_id, i, CASE WHEN regexp_matches(part, 'PEPTIDE[0-9]+\{{[^{{]*$') THEN regexp_extract(part, '^(.*PEPTIDE[0-9]+\{{)[^{{]*$', 1) || array_to_string(list_transform(string_split(regexp_extract(part, '\{{([^{{]*)$', 1), '.'),
      lambda m: CASE WHEN t[regexp_replace(m, '^\[(.*)\]$', '\1')] IS NULL THEN m WHEN m LIKE '[%' OR length(t[regexp_replace(m, '^\[(.*)\]$', '\1')]) > 1 THEN '[' || t[regexp_replace(m, '^\[(.*)\]$', '\1')] || ']' ELSE t[regexp_replace(m, '^\[(.*)\]$', '\1')] END), '.') ELSE part END AS part FROM s),
    r AS (SELECT row_id, string_agg(part, '}}' ORDER BY i) AS helm FROM x GROUP BY row_id)"""


@query(
    f"""WITH {PPI}, n AS (SELECT row_id, CASE WHEN len(list_distinct(regexp_extract_all(helm, 'PEPTIDE[0-9]+'))) = 1 THEN regexp_replace(helm, 'PEPTIDE[0-9]+', 'PEPTIDE1', 'g') ELSE helm END AS helm FROM p WHERE helm <> ''), {ALT}, {_REMAP},
    o AS (SELECT row_id, NULL AS compound_chembl_id, {LINKED} AS helm FROM r), {MON.replace(' FROM p)', ' FROM o)')}, v AS (SELECT list(DISTINCT symbol) AS v FROM monomer_library)
    SELECT row_id, helm, coalesce(len(list_filter(monomers, lambda x: NOT list_contains(v, x))) = 0, false) AS valid FROM m, v"""
)
def helm_normalized(spark, sf_dir):
    """H8: the whole normalisation as a table: blanks dropped, single chains renumbered, alternatives replaced, connections in
    order, and whether the library has every monomer."""
    library = read(spark, sf_dir, "monomer_library")
    rows = ppi(spark, sf_dir).where("helm <> ''").select("row_id", h.renumbered("helm").alias("helm"))
    rows = remap(rows, alternatives(library)).select("row_id", h.linked_in_order("helm").alias("helm"))
    symbols = library.select("symbol").distinct()
    bad = rows.select("row_id", F.explode(h.monomers("helm")).alias("symbol")).join(F.broadcast(symbols) if fits(symbols, 60) else symbols, "symbol", "left_anti").select("row_id").distinct().withColumn("bad", F.lit(True))
    return rows.join(bad, "row_id", "left").select("row_id", "helm", (h.monomers("helm").isNotNull() & F.col("bad").isNull()).alias("valid"))
