"""Tables written to the folder that all executors share, which cut a plan's lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


#: Folders made for local applications whose session names none.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names; a local application without one gets a temporary folder, a cluster an error."""
    at = spark.conf.get(SETTING, None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{SETTING} must name a folder that all executors share")
        ident = spark.sparkContext.applicationId
        at = _OWN.get(ident) or _OWN.setdefault(ident, "file://" + tempfile.mkdtemp(prefix="strandloom-"))
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/strandloom/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete every table this application has kept; results that read them must have been used or saved before."""
    _delete(spark, _folder(spark))


class Kept:
    """A table in the shared folder: ``df`` reads it, ``drop()`` deletes its files."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path = spark, path
        self.df = spark.read.schema(schema).parquet(path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def keep(df: DataFrame, name: str) -> Kept:
    """Write ``df`` as Parquet in the shared folder and return it read back.

    A lost executor costs at most the tasks it was running: what is written is never computed again.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return Kept(spark, path, df.schema)


def written(df: DataFrame, name: str, *used: Kept) -> DataFrame:
    """``keep(df, name).df`` for tables that live as long as the result; the tables ``used`` up by it are dropped."""
    out = keep(df, name).df
    for table in used:
        table.drop()
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use every core for costly per-row work: repartition only where the scan has fewer splits than
    the cluster has cores (small inputs). Large inputs have enough splits and are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming:
        return df
    return df.repartition(2 * cores, *keys) if df.rdd.getNumPartitions() < cores else df
