"""Problem 9: filling fixed-capacity containers.

Vector bin packing by the dot-product heuristic: the open container takes the item whose demand, weighted by the mean
demand for each resource, points most in the direction of the room left, among those that fit.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shared import keep
from .token_ids import token_counts

CAPACITY = 2048
#: Texts a container may hold, and tokens in it that bear loss (15 of 16).
MAX_SEGMENTS, MAX_LOSS = 256, 1920
#: Tokens of the pieces that a text larger than a container is cut into: a quarter of a container, so that pieces that bear loss
#: throughout can be put together with texts that have a prompt.
PIECE = 512
#: Items packed by one task: what one core packs in seconds.
BUCKET_ITEMS = 20_000
#: Steps after which classes that are used up are left out.
COMPACT = 64
#: Containers filled less than this are opened again and packed once more with those of other tasks.
REPACK_BELOW = 0.97


def pack(demand: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Container and position of each item (rows of ``demand``, columns as in ``limits``).

    Items of one demand are one class, so a step costs the number of classes. An item that exceeds a limit alone gets
    a container of its own. Items of no demand at all are placed like others (they take a segment if that is counted).
    """
    n = len(demand)
    container, position = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return container, position
    classes, of = np.unique(demand, axis=0, return_inverse=True)
    of = of.reshape(-1)
    waiting: dict[int, list[int]] = defaultdict(list)
    for i in range(n - 1, -1, -1):
        waiting[of[i]].append(i)
    left = np.bincount(of, minlength=len(classes))
    share = classes / limits
    weighted = share * (np.average(share, axis=0, weights=left) + 1e-12)
    room, at, held, placed, live = limits.astype(float), 0, 0, 0, np.arange(len(classes))
    while placed < n:
        if placed % COMPACT == 0:  # classes that are used up go, so that a step looks at few
            live = live[left[live] > 0]
            open_, columns, weights = np.ones(len(live), bool), np.ascontiguousarray(classes[live].T), np.ascontiguousarray(weighted[live].T)
        fits = open_.copy()
        for column, r in zip(columns, room):
            fits &= column <= r
        if fits.any():
            score = sum(w * r for w, r in zip(weights, room / limits))
            score[~fits] = -1
            k = int(score.argmax())
        elif held:
            room, at, held = limits.astype(float), at + 1, 0
            continue
        else:  # larger than a container in some way
            k = int(open_.argmax())
        c = live[k]
        i = waiting[c].pop()
        container[i], position[i] = at, held
        left[c] -= 1
        open_[k] = left[c] > 0
        room, held, placed = room - classes[c], held + 1, placed + 1
    return container, position


def cut_to_size(sizes: DataFrame, key: str, capacity: int, piece: int) -> DataFrame:
    """(key, piece_no, start_token, n_tokens, loss): one row per item, or per piece of ``piece`` tokens (the last one shorter)
    of an item larger than ``capacity``. Loss-bearing are the tokens after the first ``n_prompt``, and never the first
    one; nothing known is no tokens."""
    known = lambda c: F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0)) if c in sizes.columns else F.lit(0)
    sizes = sizes.select(key, known("n_tokens").alias("n_tokens"), F.greatest(known("n_prompt"), F.lit(1)).alias("n_prompt"))
    width = F.when(F.col("n_tokens") > capacity, piece).otherwise(capacity)
    last = F.greatest(F.ceil(F.col("n_tokens") / width) - 1, F.lit(0))
    start, n = F.col("piece_no") * width, F.least(width, F.col("n_tokens") - F.col("piece_no") * width)
    loss = F.greatest(start + n - F.greatest(start, "n_prompt"), F.lit(0))
    return sizes.withColumn("piece_no", F.explode(F.sequence(F.lit(0), last))).select(key, F.col("piece_no").cast("int").alias("piece_no"), start.cast("long").alias("start_token"), n.cast("long").alias("n_tokens"), loss.cast("long").alias("loss"))


def containers(sizes: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, bucket_items: int = BUCKET_ITEMS, piece: int | None = None) -> DataFrame:
    """(key, piece_no, start_token, n_tokens, loss, container_id, position) for each item or piece.

    ``sizes`` is (key, n_tokens) and, if there are prompts, n_prompt. An item is cut only if it has more tokens than a
    container, into pieces of ``piece`` tokens (None: a container's); one that is over another limit by itself has a
    container of its own. ``max_loss`` None bounds loss-bearing tokens by the container only. Items without tokens take a segment,
    but no tokens. Items are dealt evenly to as many tasks as their number asks for, each of which packs about
    ``bucket_items``; what is left loosely filled is gathered and packed again by fewer tasks, until one is enough or
    packing again does not halve it. Nothing depends on any one key's share.
    """
    max_loss = capacity if max_loss is None else max_loss
    items = keep(cut_to_size(sizes, key, capacity, min(piece or capacity, capacity)).withColumn("ordinal", F.monotonically_increasing_id()), "items").df
    kind = items.schema[key].dataType.simpleString()
    limits = np.array([capacity, max_segments, max_loss], float)

    def place(group, pdf):
        bucket = int(group[0])
        demand = np.stack([pdf["n_tokens"].to_numpy(float), np.ones(len(pdf)), pdf["loss"].to_numpy(float)], axis=1)
        order = np.argsort(pdf["ordinal"].to_numpy(), kind="stable")
        c, p = pack(demand[order], limits)
        fill = np.bincount(c, weights=demand[order][:, 0])
        segments = np.bincount(c)
        pdf = pdf.iloc[order].copy()
        pdf["container_id"], pdf["position"] = c, p.astype("int32")
        loss = np.bincount(c, weights=demand[order][:, 2])
        pdf["loose"] = (fill[c] < REPACK_BELOW * capacity) & (segments[c] < max_segments) & (loss[c] < REPACK_BELOW * max_loss)
        pdf["bucket"] = bucket
        return pdf

    schema = f"`{key}` {kind}, piece_no int, start_token long, n_tokens long, loss long, ordinal long, bucket int, container_id long, position int, loose boolean"
    done: list[DataFrame] = []
    todo, round_no = items, 0
    while True:
        count = todo.count()
        buckets = max(1, math.ceil(count / bucket_items))
        dealt = todo.select(key, "piece_no", "start_token", "n_tokens", "loss", "ordinal", F.pmod(F.xxhash64("ordinal", F.lit(round_no)), F.lit(buckets)).cast("int").alias("bucket"))
        got = keep(dealt.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(place, schema), "packed").df
        final = buckets == 1
        done.append((got if final else got.where("NOT loose")).withColumn("round", F.lit(round_no)))
        if final:
            break
        todo, round_no = got.where("loose").drop("container_id", "position", "loose", "bucket"), round_no + 1
        if todo.count() > 0.5 * count:  # loose because of the limits, not of the dealing
            done.append(got.where("loose").withColumn("round", F.lit(round_no)))
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    ident = F.col("round").cast("long") * F.lit(2**56) + F.col("bucket").cast("long") * F.lit(2**32) + F.col("container_id")
    return out.select(key, "piece_no", "start_token", "n_tokens", "loss", ident.alias("container_id"), "position")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as instruction data: the first paragraph of several is the prompt, all after it bears loss."""
    return containers(token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")), max_loss=MAX_LOSS, piece=PIECE)


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).drop("loss")


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are, as one row."""
    each = _packed(spark, sf_dir).groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("segments"), F.sum("loss").alias("loss"))
    return each.agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.round(F.sum("used") / (F.count("*") * CAPACITY), 6).alias("fill"), F.max("used").alias("most_tokens"), F.max("segments").alias("most_segments"), F.max(F.when(F.col("segments") > 1, F.col("loss"))).alias("most_loss"), F.count_if(F.col("loss") > MAX_LOSS).alias("n_alone_over_loss"))


QUERIES = {"p9_containers": p9_containers, "p9_fill": p9_fill}
SQL: dict[str, str] = {}
