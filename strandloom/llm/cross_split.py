"""Problem 4: same or near-same records across splits.

Sequences of different splits become candidates by banded minwise hashes of their shingles. SMILES of one family of
sequences are too alike for bands: of 4-character shingles, unrelated ones have a Jaccard similarity of 0.58 (median, 0.69
at the 95th percentile), near-equal ones 0.62 or more. So each pair across splits within a family is a candidate by
an exact count of the shingles in common. The exact Jaccard similarity is verified against the least value that
near-equal texts can have, then the edit distance itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import is_blank
from ..operators.joins import hot_keys, keyed_join
from ..shared import spread, written
from .group_splits import hash_to_min

#: Edits allowed, as a share of the longer text's characters.
EDITS = 0.05
#: Shingle length, bands and rows a band. At 5 % edits long sequences keep a similarity of 0.67 or more (found: all but
#: 1e-6); at 20 characters one edit leaves 0.62 or more (found: all but 2e-5).
SEQUENCE_LSH = (4, 40, 3)
#: Records a side and characters a side that one block of SMILES holds; texts of more characters are a block of their own.
BLOCK_ROWS, BLOCK_CHARS = 2_000, 1_000_000
#: Shingles that are counted at once, so that a block's memory does not grow with the number of distinct ones.
SLAB = 4096
#: Width of a length class, in logarithms: more than -ln(1 - EDITS), so near-equal texts are in the same class or the next.
LENGTH_STEP = 0.0514
VERIFY_SHINGLE = 4
#: Shingles of texts that one Python worker keeps (8 bytes each).
MEMO_SHINGLES = 6_000_000
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: str, k: int) -> np.ndarray:
    """Hashes of all k-character shingles, each numbered by its occurrence, so that repeats count; sorted, distinct.

    A text shorter than k has one shingle. One edit changes at most k shingles of either text.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < k:
        codes = np.pad(codes, (0, k - len(codes)))
    n = len(codes) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = _mix(h + codes[j : j + n] + np.uint64(0x9E3779B97F4A7C15))
    h.sort()
    first = np.r_[0, np.flatnonzero(h[1:] != h[:-1]) + 1]
    nth = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    return np.unique(_mix(h + nth.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))


def bands(text: str, k: int, n_bands: int, rows: int) -> np.ndarray:
    """One hash per band of the text's minwise signature."""
    x = shingles(text, k)
    r = np.random.default_rng(20_011)
    a = r.integers(1, 2**63, n_bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    c = r.integers(0, 2**63, n_bands * rows, dtype=np.uint64)
    least = np.full(n_bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), 2048):
        np.minimum(least, (x[at : at + 2048, None] * a + c).min(axis=0), out=least)
    out = np.zeros(n_bands, np.uint64)
    for row in least.reshape(n_bands, rows).T:
        out = _mix(out * np.uint64(31) + row)
    return out.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def banded(df: DataFrame, text: str, lsh: tuple[int, int, int]) -> DataFrame:
    """``df`` with one row per band: all columns but the text, n_chars, band and bucket."""
    others = [c for c in df.columns if c != text]

    def sign(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, len(b), 4096):
                part = b.slice(at, 4096)
                flat = [bands(t, *lsh) for t in part.column(text).to_pylist()]
                ends = pa.array(np.arange(0, len(flat) * lsh[1] + 1, lsh[1], dtype=np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], pa.array([len(t) for t in part.column(text).to_pylist()], pa.int32()), lists], [*others, "n_chars", "bands"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)
    return spread(df).mapInArrow(sign, f"{kinds}, n_chars int, bands array<long>").select(*others, "n_chars", F.posexplode("bands").alias("band", "bucket"))


def allowed(a: Column, b: Column) -> Column:
    """Edits allowed between texts of lengths a and b."""
    return F.floor(F.greatest(a, b) * EDITS + 1e-9).cast("int")


def verified(pairs: DataFrame, a: str = "text_a", b: str = "text_b") -> DataFrame:
    """Pairs whose exact Jaccard similarity reaches what so few edits must leave, and then whose edit distance is within
    the bound. Adds jaccard."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)

    def compare(batches):
        import pyarrow as pa

        memo: dict[str, np.ndarray] = {}
        held = 0

        def of(t):
            nonlocal held
            if t not in memo:
                if held > MEMO_SHINGLES:
                    memo.clear()
                    held = 0
                memo[t] = shingles(t, VERIFY_SHINGLE)
                held += len(memo[t])
            return memo[t]

        for batch in batches:
            j = [jaccard(of(x), of(y)) for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(j, pa.float64())], [*batch.schema.names, "jaccard"])

    edits = allowed(F.char_length(a), F.char_length(b))
    longest = F.greatest(F.char_length(a), F.char_length(b)) - VERIFY_SHINGLE + 1
    least = (longest - VERIFY_SHINGLE * edits) / (longest + VERIFY_SHINGLE * edits)  # what is left if every edit changes k shingles of both
    got = pairs.mapInArrow(compare, f"{kinds}, jaccard double").where((F.col("jaccard") >= F.least(least, F.lit(1.0)) - 1e-9) | (longest < 1))
    bound = f"cast(floor(greatest(char_length(`{a}`), char_length(`{b}`)) * {EDITS} + 1e-9) AS int)"
    return got.where(F.expr(f"`{a}` = `{b}` OR levenshtein(`{a}`, `{b}`, {bound}) >= 0"))


def near_sequences(sequences: DataFrame) -> DataFrame:
    """(q_a, q_b) of near-equal, not equal texts, q_a in train and q_b in an evaluation split; ``sequences`` is distinct
    (q, sequence, in_train, in_eval). Pairs within one side are never made."""
    rows = banded(sequences, "sequence", SEQUENCE_LSH)
    a, b = (rows.where(side).select(F.col("q").alias(f"q_{x}"), F.col("n_chars").alias(f"n_{x}"), "band", "bucket") for x, side in (("a", "in_train"), ("b", "in_eval")))
    pairs = a.join(b, ["band", "bucket"]).where((F.col("q_a") != F.col("q_b")) & (F.abs(F.col("n_a") - F.col("n_b")) <= allowed(F.col("n_a"), F.col("n_b")))).select("q_a", "q_b").distinct()
    for x in "ab":
        pairs = pairs.join(sequences.select(F.col("q").alias(f"q_{x}"), F.col("sequence").alias(f"text_{x}")), f"q_{x}")
    return verified(pairs).select("q_a", "q_b")


def blocks(shared: DataFrame) -> DataFrame:
    """One row for each record, side and block it is compared in: family, bin, i, j, train, record_id, smiles.

    A family within BLOCK_ROWS and BLOCK_CHARS is one block. Larger ones are parted by length class, where evaluation
    records go to the classes beside theirs as well, and a class is dealt into parts of which each meets each: every
    pair of near-equal length meets in exactly one block.
    """
    length = F.char_length("smiles")
    size = shared.groupBy("family").agg((F.count("*") > BLOCK_ROWS).alias("many"), (F.sum(length) > BLOCK_CHARS).alias("much"))
    own = F.when(F.col("many") | F.col("much"), F.floor(F.log(length.cast("double")) / LENGTH_STEP).cast("int")).otherwise(-2)
    rows = shared.join(size, "family").withColumn("bin", own).select("family", "bin", "record_id", "smiles", "in_train", "in_eval")
    near = F.when(F.col("bin") == -2, F.array("bin")).otherwise(F.array(*[F.col("bin") + d for d in (-1, 0, 1)]))
    train = rows.where("in_train").select("family", "bin", F.lit(True).alias("train"), "record_id", "smiles")
    evaluation = rows.where("in_eval").select("family", F.explode(near).alias("bin"), F.lit(False).alias("train"), "record_id", "smiles")
    both = train.unionByName(evaluation)
    chars = F.sum(F.when(F.col("train"), F.char_length("smiles")))
    other = F.sum(F.when(~F.col("train"), F.char_length("smiles")))
    parts = lambda n, c: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(c / BLOCK_CHARS)).cast("int")
    dealt = both.groupBy("family", "bin").agg(parts(F.count_if("train"), chars).alias("n_i"), parts(F.count_if(~F.col("train")), other).alias("n_j")).where("n_i > 0 AND n_j > 0")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = lambda n: F.array(F.pmod(F.xxhash64("record_id"), F.col(n)).cast("int"))
    placed = both.join(dealt, ["family", "bin"]).withColumn("i", F.explode(F.when(F.col("train"), mine("n_i")).otherwise(every("n_i"))))
    return placed.withColumn("j", F.explode(F.when(F.col("train"), every("n_j")).otherwise(mine("n_j")))).select("family", "bin", "i", "j", "train", "record_id", "smiles")


def close_pairs(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of all pairs that share as many shingles as near-equal texts must: e edits change at most
    VERIFY_SHINGLE * e of those of the longer text. No near-equal pair is left out."""
    texts = [shingles(t, VERIFY_SHINGLE) for t in a + b]
    sizes = np.array([len(x) for x in texts])
    _, columns = np.unique(np.concatenate(texts), return_inverse=True)
    order = np.argsort(columns, kind="stable")
    columns, rows = columns[order], np.repeat(np.arange(len(texts)), sizes)[order]
    common = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, columns[-1] + 1, SLAB):
        lo, hi = np.searchsorted(columns, [at, at + SLAB])
        held = np.zeros((len(texts), min(SLAB, columns[-1] + 1 - at)), np.float32)
        held[rows[lo:hi], columns[lo:hi] - at] = 1
        common += held[: len(a)] @ held[len(a) :].T
    n = np.array([len(t) for t in a + b])
    longer = np.maximum(n[: len(a), None], n[None, len(a) :])
    edits = np.floor(longer * EDITS + 1e-9)
    fits = longer - np.minimum(n[: len(a), None], n[None, len(a) :]) <= edits
    most = np.maximum(sizes[: len(a), None], sizes[None, len(a) :])
    return np.nonzero(fits & (common >= most - VERIFY_SHINGLE * edits))


def candidates_within(blocks: DataFrame) -> DataFrame:
    """(record_a, record_b) of a train and an evaluation record that share enough shingles, each pair once."""
    spark = blocks.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["family", "bin", "i", "j"]

    def compare(batches):
        import pyarrow as pa

        def pairs(sides):
            (a, x), (b, y) = sides[True], sides[False]
            i, j = close_pairs(x, y) if a and b else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[i]), pa.array(np.array(b, np.int64)[j])], ["record_a", "record_b"]) if len(i) else None

        now, sides = None, None
        for batch in batches:
            for *key, train, record, smiles in zip(*[c.to_pylist() for c in batch.columns]):
                if key != now:
                    if now and (got := pairs(sides)):
                        yield got
                    now, sides = key, {True: ([], []), False: ([], [])}
                sides[train][0].append(record)
                sides[train][1].append(smiles)
        if now and (got := pairs(sides)):
            yield got

    return blocks.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(compare, "record_a long, record_b long")


def overlaps(df: DataFrame, hot_rows: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(pairs, members).

    members: each train, valid or test row that has both texts, as (row_id, split, source, record_id, q): record_id stands
    for its SMILES within its family of near-equal sequences, q for its sequence. pairs: (record_a, record_b, q_a, q_b)
    of a train and an evaluation class of rows whose texts are both equal or near-equal. Exact copies share a class, so
    a text with a third of all rows is compared once. Null and blank texts and other splits take no part.

    Texts are compared whole, whatever their length; an edit distance costs length times bound. Repeated row_ids count as
    often as they are there. Empty tables and tables with one side only give no pairs.

    Sequences are grouped first (distinct texts only); within such a group every train SMILES meets every evaluation
    SMILES of near-equal length, so no pair of it is left to chance.
    """
    rows = df.where(F.col("split").isin("train", "valid", "test") & ~is_blank("canonical_smiles") & ~is_blank("target_sequence"))
    rows = rows.select("row_id", "split", "source", "canonical_smiles", F.md5("target_sequence").alias("q"), "target_sequence")
    sides = [F.max(F.col("split") == "train").alias("in_train"), F.max(F.col("split") != "train").alias("in_eval")]
    sequences = written(rows.groupBy("q").agg(F.first("target_sequence").alias("sequence"), *sides), "sequences")
    near = written(near_sequences(sequences), "near")
    families = hash_to_min(near.select(F.col("q_a").alias("src"), F.col("q_b").alias("dst"))).select(F.col("node").alias("q"), F.col("root").alias("family"))
    slim = rows.select("row_id", "split", "source", "q", F.md5("canonical_smiles").alias("s"), "canonical_smiles")
    labelled = keyed_join(slim, families, ["q"], hot_keys(slim, ["q"], slim.count(), hot_rows), "left").withColumn("family", F.coalesce("family", "q"))
    labelled = written(labelled, "labelled")
    records = labelled.groupBy("family", "s").agg(F.first("canonical_smiles").alias("smiles"), *sides)
    records = written(records.withColumn("record_id", F.monotonically_increasing_id()), "records")
    keyed = labelled.select("row_id", "split", "source", "q", "family", "s")
    members = written(keyed_join(keyed, records.select("family", "s", "record_id"), ["family", "s"], hot_keys(keyed, ["family", "s"], keyed.count(), hot_rows)).select("row_id", "split", "source", "record_id", "q", "family"), "members")
    # A family without rows on both sides has no pair.
    both = records.groupBy("family").agg(F.max("in_train").alias("t"), F.max("in_eval").alias("e")).where("t AND e").select("family")
    shared = records.join(both, "family", "left_semi")

    candidates = candidates_within(blocks(shared))
    for x in "ab":
        candidates = candidates.join(records.select(F.col("record_id").alias(f"record_{x}"), F.col("smiles").alias(f"text_{x}")), f"record_{x}")
    alike = written(verified(candidates).select("record_a", "record_b", "jaccard"), "alike")
    classes = members.select("record_id", "q", F.col("split") == "train").toDF("record_id", "q", "t").distinct()
    one = lambda x, t: classes.where(F.col("t") == t).select(F.col("record_id").alias(f"record_{x}"), F.col("q").alias(f"q_{x}"))
    pairs = alike.join(one("a", True), "record_a").join(one("b", False), "record_b")
    same = pairs.where("q_a = q_b")
    return same.unionByName(pairs.where("q_a <> q_b").join(near, ["q_a", "q_b"], "left_semi").select(*same.columns)), members


def _overlaps(spark: SparkSession, sf_dir: str):
    return overlaps(spark.read.parquet(f"{sf_dir}/ppi_split.parquet"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, members = _overlaps(spark, sf_dir)
    side = lambda x, own: members.where(own).select(F.col("record_id").alias(f"record_{x}"), F.col("q").alias(f"q_{x}"), F.col("row_id").alias(f"r_{x}"))
    rows = pairs.join(side("a", "split = 'train'"), ["record_a", "q_a"]).join(side("b", "split <> 'train'"), ["record_b", "q_b"])
    return rows.select(F.least("r_a", "r_b").alias("row_id_a"), F.greatest("r_a", "r_b").alias("row_id_b"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source of the evaluation row: pairs, and rows that overlap with train. Pairs are counted from the
    sizes of their classes, never listed."""
    pairs, members = _overlaps(spark, sf_dir)
    sizes = members.where("split = 'train'").groupBy("record_id", "q").agg(F.count("*").alias("n")).toDF("record_a", "q_a", "n_train")
    leaks = pairs.join(sizes, ["record_a", "q_a"]).groupBy("record_b", "q_b").agg(F.sum("n_train").alias("n_train"))
    rows = members.where("split <> 'train'").groupBy(F.col("record_id").alias("record_b"), F.col("q").alias("q_b"), "split", "source").agg(F.count("*").alias("n"))
    return rows.join(leaks, ["record_b", "q_b"]).groupBy("split", "source").agg(F.sum(F.col("n") * F.col("n_train")).alias("n_pairs"), F.sum("n").alias("n_rows"))


QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
_NEAR = lambda a, b: f"({a} = {b} OR (abs(length({a}) - length({b})) <= 0.05 * greatest(length({a}), length({b})) AND levenshtein({a}, {b}) <= floor(0.05 * greatest(length({a}), length({b})) + 1e-9)))"
_PAIRS = f"""
WITH r AS (SELECT row_id, split, source, canonical_smiles AS s, target_sequence AS t FROM ppi_split WHERE trim(canonical_smiles) <> '' AND trim(target_sequence) <> ''), d AS (SELECT DISTINCT t FROM r),
tp AS (SELECT a.t AS a, b.t AS b FROM d a JOIN d b ON {_NEAR('a.t', 'b.t')}),
p AS (SELECT x.row_id AS xa, y.row_id AS ya, y.split, y.source, x.s AS sa, y.s AS sb FROM r x JOIN tp ON x.t = tp.a JOIN r y ON y.t = tp.b WHERE x.split = 'train' AND y.split IN ('valid', 'test')),
f AS (SELECT * FROM p WHERE {_NEAR('sa', 'sb')})"""
SQL = {
    "p4_found": f"{_PAIRS} SELECT least(xa, ya) AS row_id_a, greatest(xa, ya) AS row_id_b FROM f",
    "p4_report": f"{_PAIRS} SELECT split, source, count(*) AS n_pairs, count(DISTINCT ya) AS n_rows FROM f GROUP BY 1, 2",
}
