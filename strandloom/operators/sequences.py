"""Token sequences and batches: monomer tokens, padding, span masks."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import md5_order

#: Ids of the special tokens; monomers and marks get ids by order of frequency after them (fixed values).
SPECIAL = {"[PAD]": 0, "[CLS]": 1, "[SEP]": 2, "[MASK]": 3, "[UNK]": 4}
TOKEN = r"\[[^\]]*\]|[A-Z]+[0-9]+|R[0-9]+|[A-Za-z]|[0-9]+|[{}$|,:.-]"


def tokens(helm) -> Column:
    """Brackets, chain names, letters, numbers and marks of a HELM text."""
    return F.regexp_extract_all(helm if isinstance(helm, Column) else F.col(helm), F.lit(TOKEN), F.lit(0))


def vocabulary(df: DataFrame, helm: str, size: int) -> DataFrame:
    """(token, id): the most frequent tokens, ties by text."""
    n = df.select(F.explode(tokens(helm)).alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(size)
    return n.select("token", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "token")) - 1 + len(SPECIAL)).cast("int").alias("id"))


def encoded(df: DataFrame, helm: str, table: DataFrame, longest: int = 512) -> DataFrame:
    """Adds ids: CLS, the tokens (UNK for those not in the table), SEP, cut to ``longest``. The table is a vocabulary of
    a fixed size, made a constant."""
    from ..functions.helm import map_column

    ids = map_column({r["token"]: str(r["id"]) for r in table.collect()})
    body = F.transform(tokens(helm), lambda t: F.coalesce(F.try_element_at(ids, t).cast("int"), F.lit(SPECIAL["[UNK]"])))
    return df.withColumn("ids", F.concat(F.array(F.lit(SPECIAL["[CLS]"])), F.slice(body, 1, longest - 2), F.array(F.lit(SPECIAL["[SEP]"]))))


def residues_encoded(df: DataFrame, sequence: str, longest: int = 1024) -> DataFrame:
    """Adds ``{sequence}_ids``: CLS, a number for each capital letter (5 for A), SEP, cut to ``longest``."""
    letters = F.regexp_extract_all(F.col(sequence), F.lit("[A-Z]"), F.lit(0))
    body = F.transform(F.slice(letters, 1, longest - 2), lambda x: F.ascii(x) - F.lit(ord("A") - len(SPECIAL)))
    return df.withColumn(f"{sequence}_ids", F.concat(F.array(F.lit(SPECIAL["[CLS]"])), body, F.array(F.lit(SPECIAL["[SEP]"]))))


def batched(df: DataFrame, number: str, size: int) -> DataFrame:
    """Adds batch_id from a number that counts rows from 0."""
    return df.withColumn("batch_id", F.floor(F.col(number) / size).cast("long"))


def padded(df: DataFrame, multiple: int = 1) -> DataFrame:
    """Pads ids to the longest of their batch, up to a multiple, and adds the attention mask."""
    longest = F.max(F.size("ids")).over(Window.partitionBy("batch_id"))
    df = df.withColumn("_w", (F.ceil(longest / multiple) * multiple).cast("int")).withColumn("_n", F.size("ids"))
    pad = F.array_repeat(F.lit(SPECIAL["[PAD]"]), F.col("_w") - F.col("_n"))
    mask = F.concat(F.array_repeat(F.lit(1), F.col("_n")), F.array_repeat(F.lit(0), F.col("_w") - F.col("_n")))
    return df.withColumn("attention_mask", mask).withColumn("ids", F.concat("ids", pad)).drop("_w", "_n")


def _draws(seed: str, key, n: int):
    for i in range(n):
        yield (int(hashlib.md5(f"{seed}:{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def masked_spans(ids: list[int], key, seed: str = "mask", share: float = 0.15, p: float = 0.2, longest: int = 5, vocabulary_size: int = 100, mask_share: float = 0.8, random_share: float = 0.1):
    """(ids, labels) after span corruption.

    About ``share`` of the tokens that are not special, in spans of geometric length (1 to ``longest``), which do not
    overlap and end with the last such token. Each span as a whole is masked, replaced at random or kept. A candidate
    start that overlaps is skipped and its length used for the next one.
    """
    special = set(SPECIAL.values()) - {SPECIAL["[UNK]"]}
    valid = [i for i, x in enumerate(ids) if x not in special]
    labels, out = [-100] * len(ids), list(ids)
    if not valid:
        return out, labels
    budget = max(1, int(len(valid) * share))
    spans = max(1, int(budget / ((1 + longest) / 2)))
    starts = [v for _, v in sorted(zip(_draws(f"{seed}s", key, len(valid)), valid))]
    lengths = [min(longest, max(1, math.ceil(math.log(1 - u) / math.log(1 - p)))) for u in _draws(f"{seed}l", key, spans)]
    taken, done = set(), 0
    last = valid[-1] + 1
    for start in starts:
        if done == spans:
            break
        span = range(start, min(start + lengths[done], last))
        if taken.isdisjoint(span):
            taken.update(span)
            u, *new = _draws(f"{seed}{start}", key, 1 + len(span))
            for j, i in enumerate(span):
                if ids[i] in special:
                    continue
                labels[i] = ids[i]
                if u < mask_share:
                    out[i] = SPECIAL["[MASK]"]
                elif u < mask_share + random_share:
                    out[i] = len(SPECIAL) + int(new[j] * (vocabulary_size - len(SPECIAL)))
            done += 1
    return out, labels


def span_mask(df: DataFrame, key: str, vocabulary_size: int, seed: str = "mask") -> DataFrame:
    """(key, ids, masked, labels) by an Arrow UDF; what is drawn depends on seed and key only."""
    @F.pandas_udf("struct<masked: array<int>, labels: array<int>>")
    def mask(k: pd.Series, ids: pd.Series) -> pd.DataFrame:
        got = [masked_spans(list(i), x, seed, vocabulary_size=vocabulary_size) for x, i in zip(k, ids)]
        return pd.DataFrame({"masked": [g[0] for g in got], "labels": [g[1] for g in got]})

    return df.withColumn("_m", mask(F.col(key), F.col("ids"))).select(key, "ids", "_m.masked", "_m.labels")


def epoch_order(df: DataFrame, key: str, seed: str) -> DataFrame:
    """(key, number): the order of one epoch."""
    from .splits import numbered

    one = df.select(key, md5_order(seed, key).alias("_o"))
    return one.join(numbered(one.select("_o"), "_o"), "_o").select(key, "number")
