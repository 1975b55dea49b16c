"""Joins against a table with one row per key that stay balanced when one key holds much of the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

#: A key is hot if it holds more rows than this share of all; so there are at most its inverse of hot keys.
HOT_SHARE = 1 / 1000
#: No key with fewer rows than this is worth a path of its own.
HOT_ROWS = 50_000
#: Bytes of the side that may be broadcast whole, and a row's assumed bytes beside its strings.
BROADCAST_BYTES = 8 << 20


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]):
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def hot_keys(df: DataFrame, keys: list[str], total: int, rows: int = HOT_ROWS) -> list:
    """Keys that hold over max(rows, total / 1000) rows, at most 1,000, from a pre-aggregated count."""
    limit = max(rows, int(total * HOT_SHARE))
    return df.groupBy(*keys).count().where(F.col("count") > limit).select(*keys).collect() if total > limit else []


def keyed_join(big: DataFrame, small: DataFrame, keys: list[str], hot: list | None = None, how: str = "inner") -> DataFrame:
    """Join ``big`` with ``small``, which has one row per key (keys not null).

    ``hot`` are the keys found by hot_keys(): their rows of ``small`` (at most 1,000, as the threshold is a share
    of the rows) are broadcast, so rows of ``big`` under a hot key are joined where they lie; all other rows meet
    by a shuffle on the key. ``how`` is inner or left. No row is dropped or sampled.
    """
    if not hot:
        return big.join(small, keys, how)
    schema = big.select(*keys).schema
    few = F.broadcast(big.sparkSession.createDataFrame(hot, schema))
    warm = F.broadcast(small.join(few, keys, "left_semi"))
    return big.join(few, keys, "left_semi").join(warm, keys, how).unionByName(big.join(few, keys, "left_anti").join(small, keys, how))


def fits(df: DataFrame, bytes_a_row: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is proven to have at most limit / bytes_a_row rows (counts no further than that)."""
    most = max(1, limit // bytes_a_row)
    return df.limit(most + 1).count() <= most


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], bytes_a_row: int, how: str = "inner") -> DataFrame:
    """Join with one row per key: broadcast where the counted size is within BROADCAST_BYTES, else by keyed_join()."""
    if fits(small, bytes_a_row):
        return big.join(F.broadcast(small), keys, how)
    return keyed_join(big, small, keys, hot_keys(big, keys, big.count()), how)
