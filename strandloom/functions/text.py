"""White space, blanks and hashes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space as Unicode has it, with the ASCII separators U+001C to U+001F.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col(c), f"^{SPACE}+|(?<!{SPACE}){SPACE}+$", "")


def squeezed(c) -> Column:
    """Without any white space."""
    return F.regexp_replace(col(c), SPACE, "")


def is_blank(c) -> Column:
    """True for null, empty and all-white-space text."""
    return col(c).isNull() | ~col(c).rlike(f"(?s)[^\\s\\p{{Z}}\\x1c-\\x1f\\x85]")


def fingerprint(*cols) -> list[Column]:
    """Two independent 64-bit hashes: together a 128-bit key (nulls count as a value of their own)."""
    parts = [x for c in cols for x in (col(c), col(c).isNull())]
    return [F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)]


def uniform(seed: str, *cols) -> Column:
    """A number in (0, 1) that depends on seed and key only: the first 13 hex digits of an MD5."""
    h = F.md5(F.concat_ws(":", F.lit(seed), *[col(c).cast("string") for c in cols]))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def md5_order(seed: str, *cols) -> Column:
    """Sort key of a seeded permutation that does not depend on the partitioning."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[col(c).cast("string") for c in cols]))
