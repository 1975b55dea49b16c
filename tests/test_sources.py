import pytest
from pyspark.sql import functions as F

from strandloom.operators import vectors as v
from strandloom.sources import readers as r, writers as w
from strandloom.streaming import incremental as inc


def test_csv_shapes(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿id,name,extra\n# note\n1E10,"a, ""b""",NA\n2,,x\n', encoding="utf-8")
    df = r.csv(spark, str(p), comment="#", null_texts=True)
    assert df.columns == ["id", "name", "extra"]
    assert [tuple(x) for x in df.collect()] == [("1E10", 'a, "b"', None), ("2", None, "x")]
    assert r.configured(spark, str(p), ["id", "extra"], {"extra": ["x"]}, ["extra"], {"id": "key"}).columns == ["key"]


def test_optional(spark, tmp_path):
    assert r.optional(spark, str(tmp_path / "none.csv"), "a string").count() == 0
    assert r.existing({"a": str(tmp_path), "b": str(tmp_path / "no")}) == {"a": str(tmp_path)}


def test_xml(spark, tmp_path):
    p = tmp_path / "m.xml"
    one = lambda i: f"<Monomer><MonomerID>{i}</MonomerID><MonomerSmiles>C</MonomerSmiles><MonomerType>Backbone</MonomerType><MonomerName>n</MonomerName><NaturalAnalog>A</NaturalAnalog></Monomer>"
    p.write_text(f'<DB xmlns="x"><L><Polymer polymerType="PEPTIDE">{one("A")}{one("B")}</Polymer><Polymer polymerType="CHEM">{one("Z")}</Polymer></L></DB>')
    assert sorted(x.symbol for x in r.monomer_xml(spark, str(p)).collect()) == ["A", "B"]


def test_complexes(spark, tmp_path):
    for n in ("1ABC_A_B", "2def_C_D", "bad_name"):
        (tmp_path / f"{n}.pdb").write_text("x")
    (tmp_path / "1abc_A.fasta").write_text(">h\nAC\n DE \n")
    (tmp_path / "1abc_B.fasta").write_text(">h\nKLM\n")
    (tmp_path / "2def_C.fasta").write_text(">h")
    good, bad = r.complex_names(spark, str(tmp_path))
    got, misses = r.joined_complexes(good, r.fasta(spark, str(tmp_path)))
    assert bad.count() == 1 and [(x.pdb, x.peptide_sequence, x.receptor_length) for x in got.collect()] == [("1abc", "ACDE", 3)]
    assert tuple(misses.first()) == (1, 0)


def test_wide_vectors_and_store(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 2.0)], "key string, sig_0 double, sig_1 double")
    wide = r.wide_vectors(df, "sig_")
    path = str(tmp_path / "store")
    assert w.add_vectors(wide, path, "e", "1", "drug") == 1 and w.add_vectors(wide, path, "e", "1", "drug") == 0
    assert w.add_vectors(wide, path, "e", "2", "drug") == 1
    assert r.stored_vectors(spark, path, "e", "1", "drug").count() == 1
    rows = spark.createDataFrame([("x",)], "text string")
    stored = rows.select(F.md5("text").alias("key"), F.array(F.lit(1.0).cast("float")).alias("vector"))
    assert v.with_embedding(rows, "text", stored).first().vector == [1.0]
    with pytest.raises(Exception, match="no embedding"):
        v.with_embedding(spark.createDataFrame([("y",)], "text string"), "text", stored).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", ["a", "b"]), (2, "test", None)], "id int, split string, ids array<string>")
    w.export_csv(df, str(tmp_path / "c"), single=True)
    assert r.csv(spark, str(tmp_path / "c")).where("id = '1'").first().ids == "a;b"
    w.splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "split=test")).count() == 1
    w.sidecar(df, str(tmp_path / "j"), seed=1)
    assert '"train":1' in spark.read.text(str(tmp_path / "j")).first().value
    assert w.report(df, "split") == "test: 1\ntrain: 1"
    assert spark.read.parquet(w.stage(df, str(tmp_path), "k")).count() == 2
    w.failed_names(df, "split", str(tmp_path / "f"))


def test_layers():
    got = r.layered({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}, overrides=["a.c=[1]", "--flag", "--lr", "0.1", "name=x"])
    assert got == {"a": {"b": 3, "c": [1]}, "flag": True, "lr": 0.1, "name": "x"}


def test_streams(spark, small, tmp_path):
    rows = spark.read.parquet(f"{small}/raw_lines.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = inc.read_stream(spark, str(tmp_path / "in"), rows.schema, files=1)
    inc.dedup_stream(stream.select("feed", "file_name"), ["feed", "file_name"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == rows.select("feed", "file_name").distinct().count() == got.select("feed", "file_name").distinct().count()
    counts = inc.windowed_counts(stream, "arrived_at", "feed").writeStream.format("memory").queryName("n").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination(120)
    assert spark.table("n").agg(F.sum("n")).first()[0] == rows.count()
    parsed = inc.parsed_stream(stream).writeStream.format("memory").queryName("p").trigger(availableNow=True).start()
    parsed.awaitTermination(120)
    assert spark.table("p").count() == rows.count()


def test_configuration_files_and_checkpoints(spark, tmp_path):
    from strandloom.sources import readers as r

    (tmp_path / "base.yaml").write_text("train:\n  lr: 0.1\n  steps: 5\nname: a\n")
    (tmp_path / "task.yaml").write_text("train:\n  lr: 0.2\n")
    paths = [f"file://{tmp_path}/{x}.yaml" for x in ("base", "none", "task")]
    assert r.layered_files(spark, *paths, overrides=["train.steps=7"]) == {"train": {"lr": 0.2, "steps": 7}, "name": "a"}
    assert list(r.existing(dict(zip("abc", paths)), spark)) == ["a", "c"]
    table = spark.createDataFrame([("m/one", 1, 0.5), ("m/two", 2, 0.3), ("m/three", 3, 0.3), ("m/four", 4, None)], "path string, step long, val_loss double")
    assert [r.resolved_checkpoint(table, x) for x in ("best", "last", "one", "nowhere")] == ["m/three", "m/four", "m/one", None]
