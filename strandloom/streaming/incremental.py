"""Structured Streaming: incremental deduplication, windowed counts with late data, parsing of arriving lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def dedup_stream(rows: DataFrame, keys: list[str], store: str, checkpoint: str):
    """Starts a query that appends rows with keys not stored yet; batches are anti-joined with what is there.

    A batch is written under its number, so that one that is run again after a failure replaces itself.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
        there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        new = batch.na.drop(subset=keys).dropDuplicates(keys)
        if there:
            old = spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])).parquet(store).where(F.col("batch") != number)
            new = new.join(old.select(*keys).distinct(), keys, "left_anti").select(*batch.columns)
        new.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts per window and kind; rows later than ``late`` behind the newest are left out."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))  # a watermark needs an instant
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def parsed_stream(lines: DataFrame) -> DataFrame:
    """Arriving lines with their reason or fields, as in parse_lines()."""
    from ..operators.line_parse import parse_lines

    return parse_lines(lines)


def read_stream(spark: SparkSession, folder: str, schema, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
