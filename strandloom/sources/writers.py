"""Tables out: stages, exports, split pairs, sidecars and the embedding store."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F


def stage(df: DataFrame, folder: str, key: str) -> str:
    """K1, K9: a typed Parquet table per stage; Spark's _SUCCESS marks that it is whole."""
    path = f"{folder.rstrip('/')}/{key}"
    df.write.mode("overwrite").parquet(path)
    return path


def export_csv(df: DataFrame, path: str, columns: list[str] | None = None, single: bool = False) -> None:
    """K1, K2, K8: CSV with header; arrays are joined by ``;``. ``single`` writes one file, for small exports only."""
    df = df.select(*(columns or df.columns))
    df = df.select(*[F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def splits(df: DataFrame, path: str, split: str = "split") -> None:
    """K3: one folder per split."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def sidecar(df: DataFrame, path: str, **facts) -> None:
    """K4: counts by split and given facts as one line of JSON."""
    n = df.groupBy("split").agg(F.count("*").alias("n"))
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("split", "n"))))
    n.agg(F.to_json(F.struct(pairs.alias("rows"), *[F.lit(json.dumps(v)).alias(k) for k, v in sorted(facts.items())])).alias("value")).write.mode("overwrite").text(path)


def report(df: DataFrame, by: str) -> str:
    """K5: counts by a column as text, all of its values, which come to the driver one partition at a time."""
    rows = df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)
    return "\n".join(f"{r[by]}: {r['n']}" for r in rows.toLocalIterator())


def failed_names(df: DataFrame, column: str, path: str) -> None:
    """K6: sorted distinct names."""
    df.select(column).distinct().orderBy(column).write.mode("overwrite").text(path)


def add_vectors(df: DataFrame, path: str, encoder: str, version: str, role: str) -> int:
    """K7: append vectors whose key is not stored yet; returns how many. ``df`` is (key, vector)."""
    spark = df.sparkSession
    new = df.dropDuplicates(["key"])
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        old = spark.read.parquet(path).where((F.col("encoder") == encoder) & (F.col("version") == version) & (F.col("role") == role))
        new = new.join(old.select("key"), "key", "left_anti")
    from ..shared import written

    new = written(new, "vectors")
    new.select("key", "vector", F.lit(encoder).alias("encoder"), F.lit(version).alias("version"), F.lit(role).alias("role")).write.mode("append").partitionBy("encoder", "version", "role").parquet(path)
    return new.count()
