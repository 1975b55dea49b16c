"""Files in: CSV in several shapes, XML monomers, FASTA, complex file names, wide vectors, layered configuration."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Texts the CSV compatibility mode takes for null (fixed values).
NULL_TEXTS = ["", "NA", "N/A", "n/a", "NaN", "nan", "None", "null", "NULL", "<NA>"]


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: list[str] | None = None, comment: str | None = None, null_texts: bool = False) -> DataFrame:
    """A CSV with header. A byte-order mark on the first name is dropped; with ``columns`` only those are
    read; lines that begin with ``comment`` are skipped; ``null_texts`` turns NA and the like into null. Without a
    schema every column is text, as ids must not become numbers."""
    r = spark.read.option("header", True).option("multiLine", False).option("escape", '"')
    if comment:
        r = r.option("comment", comment)
    df = (r.schema(schema) if schema else r).csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if columns:
        df = df.select(*columns)
    if null_texts:
        df = df.select(*[F.when(~F.trim(c).isin(NULL_TEXTS), F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    return df


def configured(spark: SparkSession, path: str, usecols: list[str] | None = None, keep: dict[str, list[str]] | None = None, drop: list[str] | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """Project, keep rows by membership, drop and rename, in this order."""
    df = csv(spark, path, columns=usecols)
    for c, values in (keep or {}).items():
        df = df.where(F.col(c).isin(values))
    return df.drop(*(drop or [])).withColumnsRenamed(rename or {})


def optional(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """An empty table where there is no file."""
    return csv(spark, path, **options) if there(spark, path) else spark.createDataFrame([], schema)


def monomer_xml(spark: SparkSession, path: str, polymer: str = "PEPTIDE") -> DataFrame:
    """(symbol, name, natural_analog, smiles, monomer_type) of the monomers of one polymer type."""
    fields = {"symbol": "MonomerID", "name": "MonomerName", "natural_analog": "NaturalAnalog", "smiles": "MonomerSmiles", "monomer_type": "MonomerType"}
    monomer = ", ".join(f"{x}: string" for x in fields.values())
    df = spark.read.format("xml").option("rowTag", "Polymer").option("ignoreNamespace", True).schema(f"_polymerType string, Monomer array<struct<{monomer}>>").load(path)
    m = df.where(F.col("_polymerType") == polymer).select(F.explode("Monomer").alias("m"))
    return m.select(*[F.trim(F.col(f"m.{x}")).alias(n) for n, x in fields.items()])


def complex_names(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(complexes, rejected) from the names of ``{pdb}_{peptide}_{receptor}.pdb``; the files are not read."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdb").option("recursiveFileLookup", True).load(folder).select(F.regexp_extract("path", r"([^/]+)\.pdb$", 1).alias("name"))
    parts = F.split("name", "_")
    good = names.where(F.size(parts) == 3).select(F.lower(parts[0]).alias("pdb"), parts[1].alias("peptide_chain"), parts[2].alias("receptor_chain"), F.concat("name", F.lit(".pdb")).alias("complex_file"))
    return good, names.where(F.size(parts) != 3)


def fasta(spark: SparkSession, folder: str) -> DataFrame:
    """(pdb, chain, sequence) of ``{pdb}_{chain}.fasta`` files; header lines go, the rest is joined. Files with fewer
    than two lines have a null sequence."""
    df = spark.read.option("pathGlobFilter", "*.fasta").text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    lines = F.transform(F.split("value", "\r?\n"), lambda x: F.trim(x))
    name = F.split(F.regexp_replace("file", r"\.fasta$", ""), "_")
    sequence = F.array_join(F.filter(lines, lambda x: ~x.startswith(">")), "")
    return df.select(F.lower(name[0]).alias("pdb"), name[1].alias("chain"), F.when(F.size(F.filter(lines, lambda x: x != "")) >= 2, sequence).alias("sequence"))


def joined_complexes(complexes: DataFrame, sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(complexes with both sequences, number of misses by side)."""
    side = lambda s: sequences.select("pdb", F.col("chain").alias(f"{s}_chain"), F.col("sequence").alias(f"{s}_sequence"))
    got = complexes.join(side("peptide"), ["pdb", "peptide_chain"], "left").join(side("receptor"), ["pdb", "receptor_chain"], "left")
    p, r = F.col("peptide_sequence").isNotNull(), F.col("receptor_sequence").isNotNull()
    misses = got.agg(F.count_if(~p).alias("no_peptide"), F.count_if(p & ~r).alias("no_receptor"))
    return got.where(p & r).select("*", F.length("peptide_sequence").alias("peptide_length"), F.length("receptor_sequence").alias("receptor_length"), F.lit(1).alias("label")), misses


def wide_vectors(df: DataFrame, prefix: str, out: str = "vector") -> DataFrame:
    """Columns ``prefix0``, ``prefix1`` ... as one array column."""
    wide = sorted((c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))
    return df.select(*[c for c in df.columns if c not in wide], F.array(*[F.col(c).cast("float") for c in wide]).alias(out))


def stored_vectors(spark: SparkSession, path: str, encoder: str, version: str, role: str, wanted: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Vectors of one encoder, version and role (partitions); only those of the wanted texts."""
    df = spark.read.parquet(path).where((F.col("encoder") == encoder) & (F.col("version") == version) & (F.col("role") == role))
    return df if wanted is None else df.join(wanted.select(F.md5(text).alias("key")).distinct(), "key", "left_semi")


def layered(*layers: dict, overrides: list[str] = ()) -> dict:
    """Later layers win, nested; overrides are ``a.b=value`` or ``--a.b value`` / ``--flag`` texts."""
    out: dict = {}

    def merge(into: dict, new: dict) -> dict:
        for k, v in new.items():
            into[k] = merge(dict(into.get(k) or {}), v) if isinstance(v, dict) and isinstance(into.get(k, {}), dict) else v
        return into

    for layer in layers:
        merge(out, json.loads(json.dumps(layer)))
    items, rest = [], list(overrides)
    while rest:
        x = rest.pop(0)
        if x.startswith("--") and "=" not in x:
            items.append((x[2:].replace("-", "_"), rest.pop(0) if rest and not rest[0].startswith("--") and "=" not in rest[0] else "true"))
        else:
            items.append(tuple(x.removeprefix("--").split("=", 1)))
    for path, value in items:
        try:
            value = json.loads(value)
        except json.JSONDecodeError:
            pass
        *nest, last = path.split(".")
        at = out
        for k in nest:
            at = at.setdefault(k, {})
        at[last] = value
    return out


def there(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def existing(paths: dict[str, str], spark: SparkSession | None = None) -> dict[str, str]:
    """The datasets whose file is there; others are skipped by name. Without a session, the active one is used."""
    spark = spark or SparkSession.active()
    return {k: p for k, p in paths.items() if there(spark, p)}


def layered_files(spark: SparkSession, *paths: str, overrides: list[str] = ()) -> dict:
    """layered() over YAML (or JSON) files, those that are there, in order."""
    import yaml

    texts = ["\n".join(r[0] for r in spark.read.text(p).coalesce(1).collect()) for p in existing({p: p for p in paths}, spark)]
    return layered(*[yaml.safe_load(t) or {} for t in texts], overrides=overrides)


def resolved_checkpoint(table: DataFrame, which: str = "best") -> str | None:
    """The path of a checkpoint from (path, step, val_loss): ``best`` by loss, ``last`` by step, else the one whose path
    is or ends in the name; null losses are never best, ties go to the later step."""
    if which == "best":
        got = table.where(F.col("val_loss").isNotNull() & ~F.isnan("val_loss")).agg(F.min_by("path", F.struct("val_loss", -F.col("step"))))
    elif which == "last":
        got = table.agg(F.max_by("path", "step"))
    else:
        got = table.where((F.col("path") == which) | F.endswith("path", F.lit(f"/{which}"))).agg(F.max_by("path", "step"))
    return got.first()[0]
