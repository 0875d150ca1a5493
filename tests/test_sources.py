from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as c
from tessera.operators.features import upsert
from tessera.sources import files, sinks
from tessera.streaming.incremental import dedup_stream, feature_sink

REPORT = [(1, "/x/a.png", "a.png", 95, "exact", 2), (1, "/x/b.png", "b.png", 95, "exact", 2)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(REPORT, files.REPORT)
    path = sinks.write_csv(df, str(tmp_path / "out/report.csv"))
    assert open(path, "rb").read(3) == b"\xef\xbb\xbf"
    assert files.read_report(spark, path).collect() == df.collect()
    assert files.read_report(spark, str(tmp_path / "none.csv")).count() == 0


def test_workbook(spark, tmp_path):
    df = spark.createDataFrame(REPORT, files.REPORT)
    path = sinks.write_workbook({"Duplicates": df}, str(tmp_path / "r.xlsx"), "confidence")
    sheet = zipfile.ZipFile(path).read("xl/worksheets/sheet1.xml").decode()
    assert 'topLeftCell="A2"' in sheet and "a.png" in sheet


def test_truth_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("image_a,image_b,is_duplicate,category\n a.png ,b.png,TRUE ,x\n")
    assert files.read_truth_pairs(spark, str(tmp_path / "t.csv")).first().asDict() == {"image_a": "a.png", "image_b": "b.png", "is_duplicate": True, "category": "x"}
    (tmp_path / "t.json").write_text(json.dumps({"true_duplicate_clusters": {"p": ["a", "b"], "q": ["c"]}}, indent=1))
    assert files.cluster_members(files.read_truth_clusters(spark, str(tmp_path / "t.json"))).count() == 2
    (tmp_path / "m.json").write_text(json.dumps({"D1_Sofas": [{"model_id": "m", "primary_file": "a", "all_views": ["a"]}], "D2_Beds": []}))
    assert files.read_manifest(spark, str(tmp_path / "m.json"), "sofas").first().model_id == "m"
    (tmp_path / "s.json").write_text(json.dumps(["b.png", "a_COPY.png", "a.png"]))
    assert [r.file_name for r in files.read_seeds(spark, str(tmp_path / "s.json")).collect()] == ["b.png", "a.png"]


def test_manifest_keys_and_files(spark, tmp_path):
    at = tmp_path / "m.json"
    at.write_text(json.dumps({"Z_Sofas": [{"model_id": "m", "primary_file": "a.png", "all_views": ["a.png"]}], "A_Sofas": [{"model_id": "n", "primary_file": "b.png", "all_views": []}], "Empty": []}, indent=2))
    read = lambda *a, **k: [r.model_id for r in files.read_manifest(spark, str(at), *a, **k).collect()]
    assert read("sofas") == ["m"] and read("A_Sofas") == ["n"] and read() == read("merged") == ["m", "n"] and read("empty") == []
    (tmp_path / "have").mkdir()
    (tmp_path / "have" / "b.png").write_bytes(b"x")
    assert read(folder=str(tmp_path / "have")) == ["n"]
    with pytest.raises(ValueError, match="Z_Sofas"):
        read("tables")


def test_demo_listing(spark, tmp_path):
    for name in ("b.JPG", "a.png", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.file_name for r in files.demo_images(spark, str(tmp_path), (".png", ".jpg")).collect()] == ["a.png", "b.JPG"]
    assert files.demo_images(spark, str(tmp_path / "none"), (".png",)).count() == 0


def test_scorecards(spark, tmp_path):
    scores = {"tp": 9, "fp": 1, "fn": 3, "precision": 90.0, "recall": 75.0, "f1": 81.82, "controls": 4, "violations": 1}
    text = sinks.scorecard_text(scores)
    assert "90.00%" in text and "3 / 4" in text and text.endswith("failed") and sinks.scorecard_text({**scores, "precision": 96.0, "recall": 92.0}).endswith("passed")
    df = spark.createDataFrame([(100, 96.5), (40, 99.0)], "target_scale int, precision double")
    assert [r["target_scale"] for r in json.loads(open(sinks.scorecard_json(df, str(tmp_path / "s.json"))).read())] == [40, 100]
    assert json.loads(open(sinks.scorecard_json(df.limit(1), str(tmp_path / "t.json"))).read())["precision"] == 96.5


def test_truth_document(spark, tmp_path):
    members = spark.createDataFrame([("p", "b"), ("p", "a"), ("q", "c")], "group_id string, file_name string")
    controls = spark.createDataFrame([("v.png", "p", "sofa", "navy")], "variant_file string, original_product string, category string, color string")
    got = json.loads(open(sinks.write_truth(members, controls, 40, str(tmp_path / "t.json"))).read())
    assert got["true_duplicate_clusters"] == {"p": ["a", "b"]} and got["unique_files"] == ["c", "v.png"] and (got["target_count"], got["actual_count"]) == (40, 4)


def test_large_workbook_comes_back(spark, tmp_path):
    df = spark.range(3_000).select(F.col("id").cast("int").alias("group_id"), F.concat(F.lit("<&> "), "id").alias("file_path"), F.lit(None).cast("string").alias("file_name"), F.lit(80).alias("confidence"), F.lit("exact").alias("match_type"), F.lit(2).alias("group_size"))
    path = sinks.write_workbook({"Other": df.limit(1), "Duplicates": df}, str(tmp_path / "r.xlsx"), "confidence")
    assert sorted(files.read_workbook(spark, path, sheet="Duplicates").collect()) == sorted(df.collect()) and files.read_workbook(spark, path).count() == 1


def test_unzip_skips_unsafe_members(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name in ("ok/a.png", "../up.png", "/abs.png", "note.txt"):
            z.writestr(name, b"x")
    (tmp_path / "z.zip").write_bytes(raw.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    got = files.unzip(spark.read.format("binaryFile").load(str(tmp_path)), (".png",))
    assert [r.path for r in got.collect()] == ["ok/a.png"]


def test_parsers(spark):
    url = spark.createDataFrame([("https://drive.google.com/drive/folders/AbC_1?x",), ("https://d/open?id=Zz9",), ("nothing",)], "u string")
    assert [r.i for r in url.select(c.drive_id("u").alias("i")).collect()] == ["AbC_1", "Zz9", None]
    one = spark.createDataFrame([(-1,), (5,)], "h long").select(c.from_hex(c.to_hex("h")).alias("h"))
    assert [r.h for r in one.collect()] == [-1, 5]


def test_upsert_keeps_what_an_update_lacks(spark):
    old = spark.createDataFrame([("f", "h", 1, "x", "2024")], "file_path string, content_hash string, p long, palette string, processed_at string")
    new = spark.createDataFrame([("f", "h", 2, "2025")], "file_path string, content_hash string, p long, processed_at string")
    assert upsert(old, new).first().asDict() == {"file_path": "f", "content_hash": "h", "p": 2, "palette": "x", "processed_at": "2025"}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00")], "k string, t string").select("k", F.col("t").cast("timestamp").alias("t"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = dedup_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "k", "t")
    q = stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("seen").count() == 2
    sink = feature_sink(str(tmp_path / "features"))
    batch = spark.createDataFrame([("f", "h"), ("f", "h"), ("g", "i")], "file_path string, content_hash string")
    sink(batch, 0)
    sink(batch, 0)
    assert spark.read.parquet(str(tmp_path / "features")).count() == 2
