"""Vectors: PCA and cluster splits by MLlib, an embedding store keyed by content, pooling and neighbours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import md5_order


def principal(df: DataFrame, vector: str, components: int, out: str = "pca"):
    """(df with ``out``, explained variance): standardised, then projected."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    scaled = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True).fit(rows).transform(rows)
    model = PCA(k=components, inputCol="_s", outputCol="_p").fit(scaled)
    return model.transform(scaled).withColumn(out, vector_to_array("_p")).drop("_v", "_s", "_p"), model.explainedVariance.toArray().tolist()


def cluster_split(df: DataFrame, key: str, vector: str, components: int = 50, clusters: int = 100, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """(key, cluster, split): max(1, floor(ratio k)) whole clusters, in a seeded order, are test."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows, _ = principal(df.select(key, vector), vector, components)
    rows = rows.select(key, array_to_vector("pca").alias("features"))
    model = KMeans(k=clusters, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
    named = model.transform(rows).select(key, "cluster")
    held = named.select("cluster").distinct()  # clusters are few, and fewer than asked for if there are fewer vectors
    order = held.orderBy(md5_order(str(seed), "cluster")).limit(max(1, int(ratio * held.count())))
    return named.join(F.broadcast(order.withColumn("split", F.lit("test"))), "cluster", "left").select(key, "cluster", F.coalesce("split", F.lit("train")).alias("split"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


#: Queries that go to all vectors at once.
BLOCK = 4096


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, key, similarity): the k most similar rows of each query by cosine, itself left out, ties by key.

    A stated set of queries is sent to the rows in blocks of a fixed size; each task keeps k rows per query before
    anything is shuffled.
    """
    q = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("_q"))
    blocks, out = max(1, -(-q.count() // block)), None
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    for b in range(blocks):
        part = F.broadcast(q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b))
        pairs = rows.join(part, F.col("query_id") != F.col(key)).select("query_id", key, F.round(cosine(F.col("_q"), F.col(vector)), 6).alias("similarity"))
        best = pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
        out = best if out is None else out.unionByName(best)
    return out


def mean_pooled(vectors: Column, mask: Column, size: int) -> Column:
    """Mean of the vectors whose mask is 1; the count is at least 1e-9."""
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, x: s + x), F.lit(1e-9))
    total = F.aggregate(F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x * m)), F.array_repeat(F.lit(0.0), size), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / n)


def attention_pooled(vectors: Column, scores: Column, mask: Column, size: int) -> Column:
    """Sum of vectors weighted by the softmax of their scores; masked ones have no weight."""
    top = F.array_max(F.zip_with(scores, mask, lambda s, m: F.when(m == 1, s)))
    raw = F.zip_with(scores, mask, lambda s, m: F.when(m == 1, F.exp(s - top)).otherwise(0.0))
    total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
    weighed = F.zip_with(vectors, raw, lambda v, w: F.transform(v, lambda x: x * w / total))
    return F.aggregate(weighed, F.array_repeat(F.lit(0.0), size), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))


def mean_pooled_rows(df: DataFrame, group: str, vector: str, mask: Column) -> DataFrame:
    """(group, dim, pooled): ``mean_pooled`` in every dimension where a group's vectors are rows; no group is held whole."""
    x = df.select(group, mask.cast("double").alias("_m"), F.posexplode(vector).alias("dim", "_x"))
    total = F.sum(F.col("_x").cast("double") * F.col("_m"))
    return x.groupBy(group, "dim").agg((total / F.greatest(F.sum("_m"), F.lit(1e-9))).alias("pooled"))


def attention_pooled_rows(df: DataFrame, group: str, vector: str, score: Column, mask: Column) -> DataFrame:
    """(group, dim, pooled): ``attention_pooled`` in every dimension where a group's vectors are rows; null if all are masked."""
    x = df.select(group, score.cast("double").alias("_s"), (mask == 1).alias("_m"), F.col(vector).alias("_v"))
    top = x.where("_m").groupBy(group).agg(F.max("_s").alias("_top"))
    rows = x.join(top, group, "left").withColumn("_w", F.when(F.col("_m"), F.exp(F.col("_s") - F.col("_top"))).otherwise(0.0))
    rows = rows.select(group, "_w", F.posexplode("_v").alias("dim", "_x"))
    return rows.groupBy(group, "dim").agg(F.try_divide(F.sum(F.col("_x").cast("double") * F.col("_w")), F.sum("_w")).alias("pooled"))


def missing_keys(wanted: DataFrame, text: str, stored: DataFrame) -> DataFrame:
    """(key, text) of distinct texts whose MD5 is not stored yet."""
    return wanted.where(F.col(text).isNotNull()).select(F.md5(text).alias("key"), text).distinct().join(stored.select("key"), "key", "left_anti")


def fill(missing: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """(key, vector) by a batch function; nothing but the batch is held."""

    def run(frames):
        import pandas as pd

        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                yield pd.DataFrame({"key": part["key"], "vector": embed(part[text].tolist())})

    return missing.select("key", text).mapInPandas(run, "key string, vector array<float>")


def with_embedding(rows: DataFrame, text: str, stored: DataFrame, strict: bool = True) -> DataFrame:
    """Rows with the stored vector of their text; a missing one is an error, or null."""
    got = rows.withColumn("key", F.md5(text)).join(stored.select("key", "vector"), "key", "left")
    return got.withColumn("vector", F.coalesce("vector", F.raise_error(F.concat(F.lit("no embedding for "), "key")).cast("array<float>"))) if strict else got


def nearest_distance(queries: DataFrame, rows: DataFrame, key: str, vector: str, block: int = BLOCK) -> DataFrame:
    """(query_id, distance): Euclidean distance of each query to the next other row, queries in blocks of fixed size."""
    q = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("_q"))
    blocks, out = max(1, -(-q.count() // block)), None
    square = F.aggregate(F.zip_with("_q", vector, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    for b in range(blocks):
        part = F.broadcast(q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b))
        best = rows.join(part, F.col("query_id") != F.col(key)).groupBy("query_id").agg(F.sqrt(F.min(square)).alias("distance"))
        out = best if out is None else out.unionByName(best)
    return out


def mlp(df: DataFrame, key: str, vector: str, layers: list[tuple], output: tuple, epsilon: float = 1e-5) -> DataFrame:
    """(key, output): through layers of (weights, bias, norm weight, norm bias), then the output layer (weights, bias).

    A layer is x W + b, plus x itself where the sizes are equal, then the exact GELU, then layer normalisation (dropout
    is nothing outside training). Whole batches go through numpy.
    """
    import math

    import numpy as np

    stack, (w_out, b_out) = [tuple(np.array(x, float) for x in layer) for layer in layers], (np.array(output[0], float), float(output[1]))
    erf = np.vectorize(math.erf, otypes=[float])
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(len(b), -1)
            for w, bias, gain, shift in stack:
                u = x @ w + bias
                u = u + x if u.shape == x.shape else u
                u = 0.5 * u * (1 + erf(u / math.sqrt(2.0))) if u.size else u
                centred = u - u.mean(1, keepdims=True)
                x = centred / np.sqrt((centred**2).mean(1, keepdims=True) + epsilon) * gain + shift
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x @ w_out + b_out if len(b) else np.zeros(0))], [key, "output"])

    return df.select(key, vector).mapInArrow(run, f"`{key}` {kind}, output double")


def embedding_inputs(rows: DataFrame, text: str, stored: DataFrame | None, tokenise) -> DataFrame:
    """Stored vectors where a store is given, else token ids by ``tokenise``."""
    return with_embedding(rows, text, stored) if stored is not None else tokenise(rows)


def by_representative(pairs: DataFrame, keys: list[str], representatives: DataFrame, stored: DataFrame) -> DataFrame:
    """The vector of each pair by way of its representative: ``representatives`` is (keys, rep_id), one per pair,
    ``stored`` (rep_id, vector). Pairs without one, or whose representative has no vector, are left out."""
    return pairs.join(representatives, keys).join(stored, "rep_id")


def dispatched(rows: DataFrame, text: str, given: str, stored: DataFrame) -> DataFrame:
    """The vector a row brings, else the stored one of its text, else null; column ``vector``."""
    got = rows.withColumn("key", F.md5(text)).join(stored.select("key", F.col("vector").alias("_stored")), "key", "left")
    return got.withColumn("vector", F.coalesce(given, "_stored")).drop("_stored", "key")


def stacked(df: DataFrame, batch: str, order: str, vector: str) -> DataFrame:
    """(batch, vectors): the vectors of each batch, of a fixed size, in order."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(vector).alias("v"))))
    return df.groupBy(batch).agg(F.transform(rows, lambda r: r["v"]).alias("vectors"))
