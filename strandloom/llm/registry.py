"""All queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

import importlib

MODULES = ("group_splits", "monomer_match", "cross_split", "survivors", "format_copies", "token_ids", "packing", "boundary_cuts")


def _modules():
    return [importlib.import_module(f"strandloom.llm.{m}") for m in MODULES]


def queries() -> dict:
    return {name: q for m in _modules() for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
