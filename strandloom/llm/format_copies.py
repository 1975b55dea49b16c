"""Problem 6: duplicates hidden by formatting differences.

Dictionary encoding: each distinct value of a free-text column is canonicalised once and gets an integer identifier;
records become field-ordered integer tuples, and the compact tuples are grouped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.helm import helm_meaning, smiles_meaning
from ..functions.text import fingerprint, is_blank
from ..operators.joins import hot_keys, keyed_join
from ..shared import written


def dictionary(df: DataFrame, column: str, canonical: Callable[[str], Column], name: str) -> DataFrame:
    """One row for each distinct value of ``column``: its 128-bit key (k1, k2) and the 128-bit integer identifier
    (i1, i2) of its canonical form. Identifiers come from the canonical text, so they are the same whichever
    executor computes them, and whenever.
    """
    raw = df.select(*[k.alias(f"{name}k{i}") for i, k in enumerate(fingerprint(column), 1)], column)
    once = raw.groupBy(f"{name}k1", f"{name}k2").agg(F.first(column).alias(column))
    return once.select(f"{name}k1", f"{name}k2", canonical(column).alias("c")).select(f"{name}k1", f"{name}k2", *[k.alias(f"{name}i{i}") for i, k in enumerate(fingerprint("c"), 1)])


def encode(df: DataFrame, row_id: str, texts: dict[str, Callable[[str], Column]], plain: list[str], hot_rows: int = 50_000) -> DataFrame:
    """(row_id, t1, t2): the 128-bit key of each record's sorted tuple of (field, value identifier).

    ``texts`` maps columns to their canonical form; ``plain`` columns count by value, null equal to null. Rows with a
    null or blank text column are left out. Only hashes of the texts travel to the dictionaries, never the texts;
    a value that holds a large share of all rows is joined by broadcast of its one dictionary row.
    """
    df = df.where(~F.array_contains(F.array(*[is_blank(c) for c in texts]), True))
    names = {c: f"d{i}" for i, c in enumerate(sorted(texts))}
    rows = df.select(row_id, *[k.alias(f"{names[c]}k{i}") for c in texts for i, k in enumerate(fingerprint(c), 1)], *[F.xxhash64(c, F.col(c).isNull()).alias(f"v_{c}") for c in plain], *[F.xxhash64(F.lit(1), c, F.col(c).isNull()).alias(f"w_{c}") for c in plain])
    total = rows.count()
    for c, canonical in texts.items():
        keys = [f"{names[c]}k1", f"{names[c]}k2"]
        rows = keyed_join(rows, dictionary(df, c, canonical, names[c]), keys, hot_keys(rows, keys, total, hot_rows))
    fields = {c: (f"{names[c]}i1", f"{names[c]}i2") for c in texts} | {c: (f"v_{c}", f"w_{c}") for c in plain}
    order = sorted(fields)  # one order of fields, whatever order the records had
    return rows.select(row_id, F.xxhash64(*[F.col(x) for c in order for x in fields[c]]).alias("t1"), F.xxhash64(F.lit(2), *[F.col(x) for c in order for x in fields[c]]).alias("t2"))


MEANINGS = {"helm_notation": helm_meaning, "normalized_smiles": smiles_meaning}
PLAIN = ["target_chembl_id", "standard_type", "relation", "standard_value"]


def copies(df: DataFrame, row_id: str = "row_id", texts: dict | None = None, plain: list[str] | None = None, hot_rows: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(groups, links): groups are (first_row_id, n_copies) for each distinct record; links are
    (first_row_id, row_id) for each row that is a copy of a smaller row_id. A row_id that occurs twice counts twice in
    n_copies and is no copy of itself. An empty table gives two empty results."""
    rows = written(encode(df, row_id, texts or MEANINGS, PLAIN if plain is None else plain, hot_rows), "tuples")
    groups = rows.groupBy("t1", "t2").agg(F.min(row_id).alias("first_row_id"), F.count("*").alias("n_copies"))
    several = groups.where("n_copies > 1").select("t1", "t2", "first_row_id")
    links = keyed_join(rows, several, ["t1", "t2"], hot_keys(rows, ["t1", "t2"], rows.count(), hot_rows)).where(F.col(row_id) != F.col("first_row_id"))
    return groups.select("first_row_id", "n_copies"), links.select("first_row_id", F.col(row_id).alias("row_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(spark.read.parquet(f"{sf_dir}/chembl_ppi.parquet"))[1]


def p6_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each distinct record with the number of its copies."""
    return copies(spark.read.parquet(f"{sf_dir}/chembl_ppi.parquet"))[0]


QUERIES = {"p6_found": p6_found, "p6_collapsed": p6_collapsed}
#: White space for DuckDB's regular expressions.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{000B}\x{001C}-\x{001F}]"
_END = lambda c, i, j: f"regexp_extract({c}, '^([^,]+),([^,]+),([^-]+)-(.+)$', {i}) || ':' || regexp_extract({c}, '^([^,]+),([^,]+),([^-]+)-(.+)$', {j})"
_COPIES = rf"""
WITH a AS (SELECT row_id, target_chembl_id, standard_type, relation, standard_value, regexp_replace(helm_notation, '{SPACE}', '', 'g') AS h, regexp_replace(normalized_smiles, '{SPACE}', '', 'g') AS s FROM chembl_ppi),
b AS (SELECT * REPLACE (string_split(CASE WHEN contains(h, '$') THEN regexp_replace(h, '[^$]*$', '') ELSE h END, '$') AS h, array_to_string(list_sort(string_split(string_split(s, '|')[1], '.')), '.') AS s) FROM a WHERE h <> '' AND s <> ''),
c AS (SELECT row_id, target_chembl_id, standard_type, relation, standard_value, s,
  list_transform(string_split(h[1], '|'), lambda p: CASE WHEN contains(p, '{{') THEN upper(string_split(p, '{{')[1]) || '{{' || array_to_string(list_transform(string_split(rtrim(string_split(p, '{{')[2], '}}'), '.'), lambda m: regexp_replace(m, '^\[(\pL)\]$', '\1')), '.') ELSE p END) AS chains,
  list_sort(list_transform(list_filter(string_split(upper(coalesce(h[2], '')), '|'), lambda x: x <> ''), lambda x: CASE WHEN {_END('x', 1, 3)} < {_END('x', 2, 4)} THEN {_END('x', 1, 3)} || '-' || {_END('x', 2, 4)} ELSE {_END('x', 2, 4)} || '-' || {_END('x', 1, 3)} END)) AS links, h[3:] AS rest FROM b),
g AS (SELECT *, min(row_id) OVER w AS first_row_id, count(*) OVER w AS n FROM c WINDOW w AS (PARTITION BY chains, links, rest, s, target_chembl_id, standard_type, relation, standard_value))"""
SQL = {
    "p6_found": f"{_COPIES} SELECT first_row_id, row_id FROM g WHERE row_id <> first_row_id",
    "p6_collapsed": f"{_COPIES} SELECT first_row_id, n AS n_copies FROM g WHERE row_id = first_row_id",
}
