"""Queries of the general data problems, with SQL where it can express them."""

from __future__ import annotations

from ..operators import line_parse, orphans

#: White space for DuckDB's regular expressions.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{000B}\x{001C}-\x{001F}]"

QUERIES = line_parse.QUERIES | orphans.QUERIES
SQL = {
    "p7_found": rf"""
WITH lib AS (SELECT DISTINCT trim(s) AS symbol, added_at, deleted_at FROM (SELECT unnest([symbol] || coalesce(string_split_regex(alt_symbols, '[;|]'), [])) AS s, added_at, deleted_at FROM monomer_library) WHERE trim(s) <> ''),
r AS (SELECT 'chembl_ppi' AS table_name, row_id, loaded_at, regexp_replace(helm_notation, '{SPACE}', '', 'g') AS h FROM chembl_ppi UNION ALL SELECT 'permeability_peptides', row_id, loaded_at, regexp_replace(helm, '{SPACE}', '', 'g') FROM permeability_peptides),
s AS (SELECT DISTINCT table_name, row_id, loaded_at, regexp_replace(m, '^\[|\]$', '', 'g') AS symbol FROM (SELECT table_name, row_id, loaded_at, unnest(string_split(b, '.')) AS m FROM (SELECT table_name, row_id, loaded_at, unnest(regexp_extract_all(h, '(?i)PEPTIDE[0-9]*\{{([^}}]*)\}}', 1)) AS b FROM r))),
j AS (SELECT table_name, row_id, s.symbol, bool_or(lib.symbol IS NOT NULL) AS ever, bool_or(added_at <= loaded_at AND (deleted_at IS NULL OR loaded_at < deleted_at)) AS held, bool_or(deleted_at <= loaded_at) AS ended FROM s LEFT JOIN lib ON s.symbol = lib.symbol WHERE s.symbol <> '' GROUP BY 1, 2, 3)
SELECT table_name, row_id, symbol, CASE WHEN NOT ever THEN 'missing' WHEN coalesce(ended, false) THEN 'deleted' ELSE 'late' END AS kind FROM j WHERE NOT coalesce(held, false)""",
}
