"""Deduplication with provenance, priorities between sources, medians, coverage and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def ranked_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order (the window is cut to rank 1 before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def first_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """As ranked_first() with ascending order columns, by partial aggregation: no task holds the rows of one key."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    rank = F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])
    return df.groupBy(*keys).agg(F.min_by(row, rank).alias("r")).select(*keys, "r.*")


def joined_ids(c: str) -> Column:
    """Distinct ids, trimmed, sorted as text, joined by ``;``."""
    return F.array_join(F.sort_array(F.collect_set(F.trim(F.col(c).cast("string")))), ";")


def deduplicate(df: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """One row per key: the smallest id tuple gives the other columns, ``source_ids`` lists the ids of the group (one
    column: ``a;b``; several: ``col=a;b|col2=c``) and ``n_rows`` counts it. Rows with a null key are dropped first."""
    df = df.na.drop(how="any", subset=keys)
    listed = joined_ids(ids[0]) if len(ids) == 1 else F.concat_ws("|", *[F.concat(F.lit(f"{c}="), joined_ids(c)) for c in ids])
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[x for c in ids for x in (F.col(c).isNull(), F.col(c))], *[F.col(c) for c in rest if c not in ids and df.schema[c].dataType.typeName() != "map"])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("r"), listed.alias("source_ids"), F.count("*").alias("n_rows")).select(*keys, "r.*", "source_ids", "n_rows")


def consistent(df: DataFrame, one: str, many: str) -> DataFrame:
    """Adds ``consistent``: false where a value of ``one`` goes with several of ``many``."""
    several = df.groupBy(one).agg(F.min(many).alias("_lo"), F.max(many).alias("_hi")).select(one, F.col("_lo").eqNullSafe(F.col("_hi")).alias("consistent"))
    return df.join(several, one, "left")


def by_priority(df: DataFrame, key: str, source: str, order: list[str], tie: str) -> DataFrame:
    """Rows of the source that comes first for each key: an anti-join in priority order, in one shuffle."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in order]), F.col(source)), F.lit(0))
    df = df.where(F.col(key).isNotNull()).withColumn("_p", F.when(rank == 0, len(order) + 1).otherwise(rank))
    return first_by_key(df, [key], ["_p", tie]).drop("_p")


def medians(df: DataFrame, key: str, values: list[str], tie: str) -> DataFrame:
    """Median of each value column per key; text that is no number counts as missing. ``tie`` picks the representative.
    The median is exact: the distinct values of a key, with their counts, are merged from partial maps into one."""
    number = lambda c: F.col(c).try_cast("double")
    return df.groupBy(key).agg(F.min(tie).alias(tie), *[F.median(number(c)).alias(c) for c in values], F.count("*").alias("n_rows"))


def family(c: str) -> Column:
    """Trimmed class, UNKNOWN for null and blank."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("UNKNOWN"))


def positives(df: DataFrame, compound: str, target: str, active: str, order: str) -> DataFrame:
    """One row of each (compound, target) that was active in any measurement, the first by ``order``."""
    return df.where(F.col(compound).isNotNull() & F.col(target).isNotNull()).groupBy(compound, target).agg(F.max(active).alias("_a"), F.min(order).alias(order)).where("_a = 1").drop("_a")


def first_known(df: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """A dimension: for each key the first non-null value of every column."""
    pick = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[pick(c) for c in columns])


def majority(df: DataFrame, member: str, split: str, order: list[str]) -> DataFrame:
    """Rows of each member in the split that holds most of them (ties: earlier in ``order``); the others are dropped."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(split))
    n = df.groupBy(member, split).agg(F.count("*").alias("_n"))
    best = n.groupBy(member).agg(F.max_by(split, F.struct("_n", -rank)).alias(split))
    return df.join(best, [member, split], "left_semi")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table itself, if it has the columns; an error that names those it lacks otherwise."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df
