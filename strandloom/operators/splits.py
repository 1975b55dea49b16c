"""Seeded random, stratified, fold and scaffold splits, and negative pairs.

All randomness is an order by MD5 of seed and key, so results depend neither on partitioning nor on retries.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import md5_order
from ..shared import written
from .chemistry import NO_SCAFFOLD, nearest_of
from .joins import lookup_join

PREFIX = 4096


def smallest(df: DataFrame, order: str, n: int) -> DataFrame:
    """The n rows with the smallest ``order`` (a distinct hex hash), without sorting the table into one partition.

    Counts of hash prefixes find the prefix the cut falls in; only the rows of that prefix (1 / 4096 of all) are ranked.
    """
    bucket = F.conv(F.substring(order, 1, 3), 16, 10).cast("int")
    counts = {r["b"]: r["n"] for r in df.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()}  # at most 4,096 rows
    whole, taken = -1, 0
    for b in range(PREFIX):
        if taken + counts.get(b, 0) > n:
            break
        taken, whole = taken + counts.get(b, 0), b
    edge = df.where(bucket == whole + 1).orderBy(order).limit(max(0, n - taken))
    return df.where(bucket <= whole).unionByName(edge)


def random_split(df: DataFrame, key: str, ratio: float, seed: str, rounding: str = "ceil") -> DataFrame:
    """Adds ``split``: test has ceil(ratio n) rows, or max(1, floor(ratio n)); ``key`` is distinct."""
    df = df.withColumn("_o", md5_order(seed, key))
    n = df.count()
    k = math.ceil(ratio * n) if rounding == "ceil" else min(n, max(1, math.floor(ratio * n)))
    test = smallest(df.select(key, "_o"), "_o", k).select(key, F.lit("test").alias("split"))
    return df.drop("_o").join(test, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def stratified_split(df: DataFrame, key: str, stratum: str, ratio: float, seed: str) -> DataFrame:
    """Adds ``split``: ceil(ratio n) test rows in all, shared out by largest remainder (ties by stratum).

    Strata are few; within one, rows are ranked by hash prefix, so no stratum is sorted by a single task.
    """
    df = df.withColumn("_o", md5_order(seed, key)).withColumn("_b", F.conv(F.substring("_o", 1, 3), 16, 10).cast("int"))
    counts = df.groupBy(stratum, "_b").agg(F.count("*").alias("n"))
    sizes = counts.groupBy(stratum).agg(F.sum("n").alias("n"))
    total = sizes.agg(F.sum("n").alias("all"))
    exact = F.lit(ratio) * F.col("n")
    share = sizes.crossJoin(F.broadcast(total)).withColumn("low", F.floor(exact + 1e-9)).withColumn("rest", F.round(exact - F.col("low"), 9))
    w = Window.partitionBy(F.lit(1))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("rest"), stratum))
    share = share.withColumn("_k", F.col("low") + (place <= F.ceil(F.lit(ratio) * F.col("all") - 1e-9) - F.sum("low").over(w)).cast("int")).select(stratum, "_k")
    before = counts.withColumn("_before", F.sum("n").over(Window.partitionBy(stratum).orderBy("_b")) - F.col("n")).select(stratum, "_b", "_before")
    rank = F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_o")) + F.col("_before")
    ranked = lookup_join(df.join(before, [stratum, "_b"]), share, [stratum], 200).withColumn("split", F.when(rank <= F.col("_k"), "test").otherwise("train"))
    return ranked.drop("_o", "_b", "_before", "_k")


def shuffled(df: DataFrame, key: str, seed: str) -> DataFrame:
    """A seeded permutation: rows in the order of their hash."""
    return df.orderBy(md5_order(seed, key), key)


def family_groups(pairs: DataFrame, family: str, target: str, folds: int) -> DataFrame:
    """(target, group_id, n): a family is one group unless it holds over 1 / folds of the rows; then each target is."""
    n = pairs.groupBy(family, target).agg(F.count("*").alias("n"))
    size = n.groupBy(family).agg(F.sum("n").alias("size"))
    total = size.agg(F.sum("size").alias("total"))
    big = F.col("size") * folds > F.col("total")
    return n.join(size, family).crossJoin(F.broadcast(total)).select(target, F.when(big, F.concat_ws("/", family, target)).otherwise(F.col(family)).alias("group_id"), "n")


def balanced_folds(groups: list[tuple[str, int]], folds: int, slack: float = 0.15, moves: int = 100) -> dict[str, int]:
    """Largest group first into the least loaded fold, then moves of a group from the fullest to the emptiest fold as
    long as that narrows the gap and a fold is off by more than ``slack``."""
    load, at = [0] * folds, {}
    for name, n in sorted(groups, key=lambda g: (-g[1], g[0])):
        f = min(range(folds), key=lambda i: (load[i], i))
        at[name], load[f] = f, load[f] + n
    size, goal = dict(groups), sum(n for _, n in groups) / folds
    for _ in range(moves):
        hi, lo = max(range(folds), key=lambda i: load[i]), min(range(folds), key=lambda i: load[i])
        if goal == 0 or max(load[hi] - goal, goal - load[lo]) <= slack * goal:
            break
        fits = [g for g, f in at.items() if f == hi and 0 < size[g] < load[hi] - load[lo]]
        if not fits:
            break
        g = min(fits, key=lambda x: (abs((load[hi] - load[lo]) / 2 - size[x]), x))
        at[g] = lo
        load[hi], load[lo] = load[hi] - size[g], load[lo] + size[g]
    return at


#: Groups placed one by one; smaller ones are dealt by hash into this many lots first, which are placed instead.
DIRECT_GROUPS = 20_000


def fold_assignment(groups: DataFrame, ratio: float) -> DataFrame:
    """(group_id, fold, is_test) from (group_id, n): K = max(2, round(1 / ratio)) folds, test the one nearest to ratio.

    The largest DIRECT_GROUPS groups are placed one by one. All others, each of which is smaller, are pooled by hash
    into DIRECT_GROUPS lots, so that what reaches the driver is bounded whatever the number of groups.
    """
    folds = max(2, round(1 / ratio))
    groups = written(groups.groupBy("group_id").agg(F.sum("n").alias("n")), "groups")
    top = groups.orderBy(F.desc("n"), "group_id").limit(DIRECT_GROUPS).select("group_id", F.lit(True).alias("direct"))
    named = groups.join(top, "group_id", "left").withColumn("lot", F.when(F.col("direct"), F.concat(F.lit("g:"), "group_id")).otherwise(F.concat(F.lit("h:"), F.pmod(F.xxhash64("group_id"), F.lit(DIRECT_GROUPS)).cast("string"))))
    lots = [(r["lot"], r["n"]) for r in named.groupBy("lot").agg(F.sum("n").alias("n")).collect()]
    at, total = balanced_folds(lots, folds), sum(n for _, n in lots) or 1
    load = [sum(n for g, n in lots if at[g] == f) for f in range(folds)]
    test = min(range(folds), key=lambda f: (abs(load[f] / total - ratio), f))
    table = groups.sparkSession.createDataFrame([(g, f, f == test) for g, f in at.items()], "lot string, fold int, is_test boolean")
    return named.join(table, "lot").select("group_id", "n", "fold", "is_test")


def negative_pairs(positives: DataFrame, left: str, right: str, per_positive: int, seed: str, excluded: DataFrame | None = None) -> DataFrame:
    """(left, right) pairs that are no positives, ``per_positive`` for each positive, or all there are if fewer.

    Pools are the distinct ids of the positives, numbered in order. Draws are hashes of their number modulo the pool's
    size; distinct ones that no positive holds are taken in hash order. The number of draws doubles until there are
    enough; where the wanted pairs are a large part of all there are, every pair is numbered instead. No list of all
    pairs is built otherwise, and pools are joined by number, not crossed.
    """
    spark = positives.sparkSession
    known = positives.select(left, right)
    known = written((known if excluded is None else known.unionByName(excluded.select(left, right))).distinct(), "known")
    a, b = numbered(positives.select(left).distinct(), left), numbered(positives.select(right).distinct(), right)
    n_a, n_b, n_pos = a.count(), b.count(), positives.select(left, right).distinct().count()
    inside = known.join(a, left, "left_semi").join(b, right, "left_semi").count()
    free, want = n_a * n_b - inside, min(n_pos * per_positive, n_a * n_b - inside)
    draws = max(1000, 2 * want)
    while True:
        every = draws * 2 >= n_a * n_b
        ids = spark.range(n_a * n_b if every else draws)
        drawn_number = lambda what, n: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(what), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long") % n
        pick = lambda what, n: (F.col("id") / n_b).cast("long") if every and what == "a" else F.col("id") % n_b if every else drawn_number(what, n)  # noqa: E731, B023
        drawn = ids.select(pick("a", n_a).cast("long").alias("i"), pick("b", n_b).cast("long").alias("j")).distinct()
        pairs = drawn.join(a.withColumnRenamed("number", "i"), "i").join(b.withColumnRenamed("number", "j"), "j").select(left, right).join(known, [left, right], "left_anti")
        pairs = written(pairs.withColumn("_o", md5_order(seed, left, right)), "negatives")
        if every or free == 0 or pairs.count() >= want:
            return smallest(pairs, "_o", want).drop("_o")
        draws *= 2


def split_negatives(positives: DataFrame, left: str, right: str, split: str, order: list[str], per_positive: int, seed: int) -> DataFrame:
    """(left, right, split) negatives for each split, from the ids of its own positives.

    Splits are served in ``order``: each excludes all positives of every split and the negatives of the splits before, so
    no pair is drawn twice. The k-th split's seed is ``seed + k``.
    """
    taken = everything = positives.select(left, right).distinct()
    out = None
    for k, name in enumerate(order):
        own = positives.where(F.col(split) == name).select(left, right)
        got = written(negative_pairs(own, left, right, per_positive, str(seed + k), excluded=taken), "split-negatives")
        taken = taken.unionByName(got)
        part = got.withColumn(split, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else everything.limit(0).withColumn(split, F.lit(None).cast("string"))


def running_sum(df: DataFrame, value, order: list, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to this one in a total order, without one task that sees all rows:
    sums within range partitions, plus those of the partitions before (one number each)."""
    df = written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    sums = {r["_p"]: r["n"] for r in df.groupBy("_p").agg(F.sum(value).alias("n")).collect()}  # one row per partition
    start, before = 0, {}
    for p in sorted(sums):
        before[p], start = start, start + sums[p]
    inside = F.sum(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    offset = F.element_at(F.create_map(*[F.lit(x) for p, o in before.items() for x in (p, o)]), F.col("_p")) if before else F.lit(0)
    return df.withColumn(out, (inside + offset).cast("long")).drop("_p")


def numbered(df: DataFrame, column: str) -> DataFrame:
    """(column, number from 0 in the order of the column), by range partitions and their offsets."""
    return running_sum(df.select(column), F.lit(1), [F.col(column)], "number").select(column, (F.col("number") - 1).alias("number"))


STRATEGIES = {"small_first": ["n ASC"], "large_first": ["n DESC"], "two_assays_first": ["both_assays DESC", "n ASC"], "seeded": []}


def scaffold_orders(groups: DataFrame, ratio: float, seed: str = "scaffold") -> DataFrame:
    """(strategy, scaffold, n, running, goal, in_test): for each candidate order of the groups, test takes groups from
    the front until it would exceed round(ratio rows)."""
    total = groups.agg(F.round(F.sum("n") * ratio).cast("long").alias("goal"))
    out = None
    for name, order in STRATEGIES.items():
        cols = [F.expr(o.split()[0]).asc() if o.endswith("ASC") else F.expr(o.split()[0]).desc() for o in order] + [F.col("_o")]
        one = running_sum(groups.withColumn("strategy", F.lit(name)).withColumn("_o", md5_order(seed, "scaffold")), F.col("n"), cols, "running")
        out = one if out is None else out.unionByName(one)
    return out.crossJoin(F.broadcast(total)).withColumn("in_test", F.col("running") <= F.col("goal")).select("strategy", "scaffold", "n", "running", "goal", "in_test")


def scaffold_scores(orders: DataFrame) -> DataFrame:
    """One row per strategy: gap to the goal, share of tiny groups and of rows without scaffold in test, place."""
    t = F.col("in_test")
    scored = orders.groupBy("strategy").agg(F.coalesce(F.sum(F.when(t, F.col("n"))), F.lit(0)).alias("n_test"), F.max("goal").alias("goal"), F.coalesce(F.sum(F.when(t & (F.col("n") <= 2), F.col("n"))), F.lit(0)).alias("n_tiny"), F.count_if(t).alias("n_groups"))
    scored = scored.withColumn("gap", F.abs(F.col("n_test") - F.col("goal"))).withColumn("tiny_share", F.round(F.col("n_tiny") / F.greatest(F.col("n_test"), F.lit(1)), 6))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("gap", "tiny_share", "strategy"))).select("strategy", "n_test", "goal", "n_groups", "tiny_share", "gap", "place")


def greedy_partition(sizes: list[int], states: list, goal: int, empty, combine: Callable, key: Callable) -> list[bool]:
    """Whether each group, in the order given, goes to test.

    A group is added if the goal can't be reached without it, or if it brings ``key(size, state)`` down and does not
    overshoot; a group that does not fit is passed over. Then the best of what is left, by key and the first of equals, is
    added until the goal is reached. ``combine`` adds a group's state (hashable) to that of the test set.
    """
    chosen, rest, size, state = [False] * len(sizes), sum(sizes), 0, empty
    for k, (n, own) in enumerate(zip(sizes, states)):
        rest -= n
        added = combine(state, own)
        must = size < goal and size + rest < goal
        if must or (size + n <= goal and key(size + n, added) < key(size, state)):
            chosen[k], size, state = True, size + n, added
    # Groups of one size and state have one key, so only the first of each is looked at.
    alike: dict = {}
    for k in range(len(sizes) - 1, -1, -1):
        if not chosen[k]:
            alike.setdefault((sizes[k], states[k]), []).append(k)
    while size < goal and alike:
        n, own = best = min(alike, key=lambda x: (key(size + x[0], combine(state, x[1])), alike[x][-1]))
        chosen[alike[best].pop()] = True
        if not alike[best]:
            del alike[best]
        size, state = size + n, combine(state, own)
    return chosen


#: Assays a group's rows have; the rarest comes first in orders and keys.
CATEGORIES = ("pampa_only", "caco2_only", "both")
#: In this order for equal scores.
GREEDY = ("large_first", "small_first", "rare_large_first", "rare_small_first", "seeded_large_first", "seeded_small_first")


def composition_key(size: int, counts: tuple, total: int, totals: tuple, goal: int) -> tuple:
    """Gaps to each category's share of the goal, the rarest first, then that of the size."""
    gaps = [abs(counts[c] - totals[c] * goal / total) if totals[c] > 0 else 0.0 for c in sorted(range(len(totals)), key=lambda c: totals[c])]
    return (*gaps, abs(size - goal))


def greedy_orders(groups: DataFrame, ratio: float) -> DataFrame:
    """(strategy, scaffold, n, goal, CATEGORIES, in_test) from (scaffold, n, first_id, rarity, CATEGORIES).

    The rarest category leads each order, then rarity if the strategy has it, size, and the later first row. A seeded
    order is the same as without a seed, as in the reference: first rows are distinct, so no tie is left to the seed. One
    task holds the group table of a strategy.
    """
    kinds = "strategy string, scaffold string, n long, goal long, pampa_only long, caco2_only long, both long, in_test boolean"

    def place(table):
        import pyarrow as pa

        rows = table.to_pylist()
        name, counts = rows[0]["strategy"], lambda r: tuple(r[c] for c in CATEGORIES)
        total, totals = sum(r["n"] for r in rows), tuple(sum(r[c] for r in rows) for c in CATEGORIES)
        goal, first = round(total * ratio), sorted(range(len(totals)), key=lambda c: totals[c])
        rows.sort(key=lambda r: (tuple((counts(r)[c] > 0, counts(r)[c]) for c in first), r["rarity"] if name.startswith("rare") else 0.0, -r["n"] if "small" in name else r["n"], r["first_id"]), reverse=True)
        chosen = greedy_partition([r["n"] for r in rows], [counts(r) for r in rows], goal, (0,) * len(totals), lambda a, b: tuple(x + y for x, y in zip(a, b)), lambda size, state: composition_key(size, state, total, totals, goal))
        column = lambda c, kind: pa.array([r[c] for r in rows], kind)
        fields = {"strategy": column("strategy", pa.string()), "scaffold": column("scaffold", pa.string()), "n": column("n", pa.int64()), "goal": pa.array([goal] * len(rows), pa.int64())}
        return pa.table(fields | {c: column(c, pa.int64()) for c in CATEGORIES} | {"in_test": pa.array(chosen)})

    every = groups.withColumn("strategy", F.explode(F.array(*[F.lit(x) for x in GREEDY])))
    return every.select("strategy", "scaffold", "n", "first_id", "rarity", *CATEGORIES).groupBy("strategy").applyInArrow(place, kinds)


def greedy_scores(orders: DataFrame, prints: DataFrame) -> DataFrame:
    """One row per strategy: gap of the size, mean (by rows) and worst similarity of test scaffolds to train, shares of
    groups of one or two rows and of rows without scaffold, gaps of the categories; place 1 is the least in that order,
    where the rarest category's gap comes first. ``prints`` is (scaffold, bits)."""
    test = lambda s: F.coalesce(F.max(F.when(F.col("strategy") == s, F.col("in_test"))), F.lit(False))
    sides = orders.groupBy("scaffold").agg(F.array(*[test(s) for s in GREEDY]).alias("tests")).join(prints, "scaffold")
    near = nearest_of(sides, "scaffold", F.col("tests"), F.transform("tests", lambda x: ~x))
    near = near.select("scaffold", F.posexplode("nearest").alias("k", "similarity"))
    rows = orders.withColumn("k", F.array_position(F.array(*[F.lit(s) for s in GREEDY]), F.col("strategy")).cast("int") - 1).join(near, ["scaffold", "k"], "left")
    t, n = F.col("in_test"), F.col("n")
    like = F.when(t, F.coalesce("similarity", F.lit(1.0)))  # without a fingerprint, or with none in train
    of_test = lambda c: F.coalesce(F.sum(F.when(t & c, n)), F.lit(0))
    totals = orders.where(F.col("strategy") == GREEDY[0]).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CATEGORIES], F.sum("n").alias("n")).first()
    gap = lambda c: F.abs(F.coalesce(F.sum(F.when(t, F.col(c))), F.lit(0)) - F.lit(float(totals[c])) * F.max("goal") / F.lit(totals["n"] or 1))
    scored = rows.groupBy("strategy").agg(
        F.max("k").alias("k"), of_test(F.lit(True)).alias("n_test"), F.max("goal").alias("goal"), F.count_if(t).alias("n_groups"),
        F.coalesce(F.round(F.sum(like * n) / F.sum(F.when(t, n)), 9), F.lit(1.0)).alias("mean_similarity"), F.coalesce(F.max(like), F.lit(1.0)).alias("worst_similarity"),
        of_test(n <= 2).alias("tiny"), of_test(F.col("scaffold") == NO_SCAFFOLD).alias("bare"), *[gap(c).alias(f"{c}_gap") for c in CATEGORIES],
    )
    share = lambda c: F.when(F.col("n_test") > 0, F.col(c) / F.col("n_test")).otherwise(1.0)
    scored = scored.withColumn("gap", F.abs(F.col("n_test") - F.col("goal"))).withColumn("tiny_share", share("tiny")).withColumn("no_scaffold_share", share("bare"))
    order = ["gap", "mean_similarity", "worst_similarity", "tiny_share", "no_scaffold_share", *[f"{c}_gap" for c in sorted(CATEGORIES, key=lambda c: totals[c])]]
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order, "k"))
    return scored.withColumn("place", place).select("strategy", "n_test", "goal", "n_groups", "gap", "mean_similarity", "worst_similarity", "tiny_share", "no_scaffold_share", *[f"{c}_gap" for c in CATEGORIES], "place")
