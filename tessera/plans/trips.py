"""Queries that write files with the sinks and read them back with the sources."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import base_name
from tessera.operators import reports
from tessera.operators.pairs import exact_members
from tessera.plans.registry import query
from tessera.runtime import materialize, python_workers, shared_dir, table
from tessera.sources import files, sinks

DOCS = "docs AS (SELECT doc_id, format('doc/{:010d}', doc_id) AS path, sha256(text) AS exact_hash, octet_length(encode(text)) AS length FROM documents)"
MEMBERS = f"""{DOCS}, raw AS (SELECT list_sort(list(DISTINCT path)) AS members FROM docs WHERE exact_hash IS NOT NULL GROUP BY exact_hash HAVING count(DISTINCT path) >= 2),
grp AS (SELECT row_number() OVER (ORDER BY len(members) DESC, members[1]) AS group_id, members, len(members) AS group_size FROM raw), member AS (SELECT group_id, unnest(members) AS path, unnest(range(len(members))) AS nth, group_size FROM grp)"""
REPORT = f"WITH {MEMBERS} SELECT group_id::INT AS group_id, path AS file_path, regexp_extract(path, '([^/]*)$', 1) AS file_name, 100 AS confidence, 'exact' AS match_type, group_size::INT AS group_size FROM member"


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/tessera/trip-{uuid.uuid4().hex}"


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.format_string("doc/%010d", "doc_id").alias("path"), F.sha2("text", 256).alias("exact_hash"), F.octet_length("text").alias("length"))


def _report(spark, d) -> DataFrame:
    return materialize(reports.group_report(exact_members(_docs(spark, d))), "report")


@query(REPORT)
def report_csv(spark, d):
    """The group report through a CSV file with a byte order mark."""
    path = sinks.write_csv(_report(spark, d), f"{_folder(spark)}/report.csv")
    return files.read_report(spark, path)


@query(REPORT)
def report_workbook(spark, d):
    """The group report through the sheets of a workbook."""
    path = sinks.write_workbook({"Duplicates": _report(spark, d), "Summary": spark.createDataFrame([("a", "1")], "metric string, value string")}, f"{_folder(spark)}/report.xlsx", "confidence")
    return files.read_workbook(spark, path)


@query(f"""WITH {MEMBERS}, i AS (SELECT regexp_extract(docs.path, '([^/]*)$', 1) AS file_name, CASE WHEN nth IS NULL THEN 'UNIQUE' WHEN nth = 0 THEN 'CANONICAL_MASTER' ELSE 'DUPLICATE' END AS status,
CASE WHEN nth IS NULL THEN 'KEEP_UNIQUE' WHEN nth = 0 THEN 'KEEP_MASTER' ELSE 'ARCHIVE_DUPLICATE' END AS recommended_action, group_id, docs.path AS file_path FROM docs LEFT JOIN member USING (path))
SELECT (row_number() OVER (ORDER BY CASE status WHEN 'DUPLICATE' THEN 0 WHEN 'CANONICAL_MASTER' THEN 1 ELSE 2 END, coalesce(group_id, 999999), file_name, file_path) - 1)::BIGINT AS place, file_name, status, recommended_action, group_id::INT AS group_id, file_path FROM i""")
def inventory_csv(spark, d):
    """The inventory in its order through a CSV file: place is the line."""
    docs = _docs(spark, d)
    stock = reports.inventory(docs.withColumnRenamed("exact_hash", "sha256"), exact_members(docs)).orderBy(*reports.inventory_order())
    lines = stock.select("file_name", "status", "recommended_action", "group_id", "file_path")
    rows = files.read_inventory(spark, sinks.write_csv(lines, f"{_folder(spark)}/inventory.csv"))
    # one file is read in its order
    return rows.coalesce(1).select(F.monotonically_increasing_id().alias("place"), *lines.columns)


@query("SELECT 'a' || l_orderkey AS image_a, 'b' || l_linenumber AS image_b, l_returnflag = 'R' AS is_duplicate, l_linestatus AS category FROM lineitem WHERE l_orderkey % 50 = 0")
def truth_csv(spark, d):
    rows = table(spark, d, "lineitem").where("l_orderkey % 50 = 0")
    flag = F.when(F.col("l_returnflag") == "R", " TRUE").otherwise("false ")
    rows = rows.select(F.concat(F.lit(" a"), "l_orderkey").alias("image_a"), F.concat(F.lit("b"), "l_linenumber", F.lit(" ")).alias("image_b"), flag.alias("is_duplicate"), F.col("l_linestatus").alias("category"))
    return files.read_truth_pairs(spark, sinks.write_csv(rows, f"{_folder(spark)}/truth.csv"))


@query("""WITH m AS (SELECT 'g' || s_nationkey AS group_id, s_name AS file_name, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier), t AS (SELECT count(*) AS n FROM supplier)
SELECT group_id, file_name, 'cluster' AS kind FROM m WHERE n >= 2 UNION ALL SELECT NULL, file_name, 'unique' FROM m WHERE n = 1 UNION ALL SELECT NULL, r_name || '.png', 'unique' FROM region
UNION ALL SELECT NULL, r_name || '.png', 'control' FROM region UNION ALL SELECT NULL, (t.n + 5)::VARCHAR, 'actual' FROM t""")
def truth_json(spark, d):
    """Cluster truth through a JSON document: members of clusters, unique files, controls and the count."""
    members = table(spark, d, "supplier").select(F.concat(F.lit("g"), "s_nationkey").alias("group_id"), F.col("s_name").alias("file_name"))
    controls = table(spark, d, "region").select(F.concat("r_name", F.lit(".png")).alias("variant_file"), F.lit("p").alias("original_product"), F.lit("sofa").alias("category"), F.lit("navy").alias("color"))
    truth = files.read_truth_clusters(spark, sinks.write_truth(members, controls, 10, f"{_folder(spark)}/truth.json"))
    none = F.lit(None).cast("string").alias("group_id")
    out = files.cluster_members(truth).select("group_id", "file_name", F.lit("cluster").alias("kind"))
    out = out.unionByName(truth.select(none, F.explode("unique_files").alias("file_name"), F.lit("unique").alias("kind")))
    out = out.unionByName(truth.select(F.explode("negative_controls").alias("c")).select(none, F.col("c.variant_file").alias("file_name"), F.lit("control").alias("kind")))
    return out.unionByName(truth.select(none, F.col("actual_count").cast("string").alias("file_name"), F.lit("actual").alias("kind")))


@query("""WITH m AS (SELECT 'D' || n_regionkey || '_Rooms' AS domain, n_name AS model_id, lower(n_name) || '.png' AS primary_file FROM nation)
SELECT 'like' AS asked, domain, model_id, primary_file, primary_file || ',x' AS views FROM m WHERE domain = 'D1_Rooms' UNION ALL SELECT 'all', domain, model_id, primary_file, primary_file || ',x' FROM m""")
def manifest_json(spark, d):
    """A domain manifest through JSON: the first domain like a name, and all of them."""
    n = table(spark, d, "nation")
    file = F.concat(F.lower("n_name"), F.lit(".png"))
    models = n.select(F.concat(F.lit("D"), "n_regionkey", F.lit("_Rooms")).alias("domain"), F.col("n_name").alias("model_id"), file.alias("primary_file"), F.array(file, F.lit("x")).alias("all_views"))
    path = sinks.write_manifest(models, f"{_folder(spark)}/manifest.json")
    read = lambda asked, name: files.read_manifest(spark, path, name).select(F.lit(asked).alias("asked"), "domain", "model_id", "primary_file", F.array_join("all_views", ",").alias("views"))
    return read("like", "d1_rooms").unionByName(read("all", "merged"))


@query("SELECT n_name || '.png' AS file_name, (n_nationkey - 3)::INT AS seq FROM nation WHERE n_nationkey >= 3 AND n_nationkey % 4 <> 0 ORDER BY n_nationkey LIMIT 9")
def seeds_json(spark, d):
    """A list of names through JSON: those that are there, without marks of generated files, the first nine."""
    import json

    rows = table(spark, d, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name").collect()  # 25 rows
    names = [r["n_name"] + (".png" if r["n_nationkey"] >= 3 else "_COPY.png") for r in rows]
    path = sinks._write_text(f"{_folder(spark)}/seeds.json", json.dumps(names))
    present = table(spark, d, "nation").where("n_nationkey % 4 <> 0").select(F.concat("n_name", F.lit(".png")).alias("file_name"))
    return files.read_seeds(spark, path, present, 9).select("file_name", (F.col("seq") - 3).alias("seq"))


@query("""WITH t AS (SELECT s_suppkey AS k, s_name || CASE s_suppkey % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.png' ELSE '.JPG' END AS name FROM supplier)
SELECT 'zip' || (k % 5) AS archive, 'sub/' || name AS path, md5(name) AS digest FROM t WHERE k % 3 <> 0""")
def archive_members(spark, d):
    """Image members of archives, without those that step out of their folder."""
    python_workers(spark)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        import io
        import zipfile

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            for name in pdf["name"]:
                archive.writestr(f"sub/{name}", name)
                archive.writestr(f"../{name}", "outside")
        return pd.DataFrame({"path": ["zip" + str(pdf["k"].iloc[0] % 5)], "content": [out.getvalue()]})

    end = F.when(F.col("s_suppkey") % 3 == 0, ".txt").when(F.col("s_suppkey") % 3 == 1, ".png").otherwise(".JPG")
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.concat("s_name", end).alias("name"))
    archives = rows.groupBy(F.col("k") % 5).applyInPandas(pack, "path string, content binary")
    return files.unzip(archives, (".png", ".jpg")).select("archive", "path", F.md5("content").alias("digest"))


@query("""WITH s AS (SELECT s_suppkey AS k, s_nationkey % 3 AS g, 'chair_' || CASE s_suppkey % 2 WHEN 0 THEN 'model_' ELSE '' END || (s_suppkey // 2) || '.png' AS name, s_suppkey % 4 = 0 AS dup FROM supplier)
SELECT CASE WHEN dup THEN format('group_{:04d}_{}', g, CASE WHEN name LIKE 'chair_model_%' THEN 'chair' ELSE 'item' END) ELSE 'clean' END AS dest, name AS file_name, md5(k::VARCHAR) AS digest FROM s""")
def exported_files(spark, d):
    """Files copied into folders by destination, then listed and read again."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("chair_"), F.when(k % 2 == 0, "model_").otherwise(""), F.floor(k / 2).cast("string"), F.lit(".png"))
    rows = table(spark, d, "supplier").select(name.alias("file_name"), F.format_string("in/%06d/x", k).alias("path"), k.cast("string").cast("binary").alias("content"), (F.col("s_nationkey") % 3).alias("group_id"), F.when(k % 4 == 0, "DUPLICATE").otherwise("UNIQUE").alias("status"))
    folder = _folder(spark)
    sinks.export_files(rows.select("status", "group_id", "file_name", F.col("path").alias("file_path")), rows.select("path", "content"), folder)
    found = files.discover(spark, folder, (".png",))
    return found.select(F.element_at(F.split("path", "/"), -2).alias("dest"), base_name("path").alias("file_name"), F.md5("content").alias("digest"))


@query("""WITH s AS (SELECT n_nationkey AS target_scale, n_regionkey AS precision_ FROM nation), fresh AS (SELECT target_scale, 100 + precision_ AS precision_ FROM s WHERE target_scale % 3 = 0)
SELECT target_scale::INT AS target_scale, precision_::INT AS precision_ FROM fresh UNION ALL SELECT target_scale::INT, precision_::INT FROM s WHERE target_scale % 3 <> 0""")
def ladder_scores(spark, d):
    """Scorecard rows where new ones replace those of their scale, through JSON."""
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("target_scale"), F.col("n_regionkey").alias("precision_"))
    both = sinks.upsert_scores(rows, rows.where("target_scale % 3 = 0").withColumn("precision_", F.col("precision_") + 100))
    return spark.read.schema("target_scale int, precision_ int").option("multiLine", True).json(sinks.scorecard_json(both, f"{_folder(spark)}/scores.json"))


@query("""WITH o AS (SELECT o_orderpriority AS kind, (o_orderkey % 3 = 0) = (o_custkey % 2 = 0) AS correct FROM orders WHERE o_orderkey % 100 = 0), n AS (SELECT 'one' AS dataset, * FROM o UNION ALL SELECT 'two', * FROM o WHERE kind < '3')
SELECT dataset, kind, count(*)::INT AS cases, count(*) FILTER (correct)::INT AS correct, round(100.0 * count(*) FILTER (correct) / count(*), 1)::DOUBLE AS accuracy FROM n GROUP BY 1, 2""")
def evaluation_csv(spark, d):
    """Cases of two data sets as CSV, and their summary read back."""
    cases = table(spark, d, "orders").where("o_orderkey % 100 = 0").select("o_orderkey", F.col("o_orderpriority").alias("kind"), ((F.col("o_orderkey") % 3 == 0) == (F.col("o_custkey") % 2 == 0)).alias("correct"))
    written = sinks.write_evaluation({"one": cases, "two": cases.where("kind < '3'")}, _folder(spark))
    return files._read_csv(spark, written[-1], "dataset string, kind string, cases int, correct int, accuracy double")


@query("""WITH n AS (SELECT n_name AS name, n_nationkey % 7 AS k FROM nation), g AS (SELECT k, list_sort(list(name || '.png')) AS m FROM n GROUP BY 1 HAVING count(*) >= 2)
SELECT (row_number() OVER (ORDER BY len(m) DESC, m[1]))::BIGINT AS group_id, array_to_string(m, ',') AS members, 100 AS confidence, 'exact' AS match_type FROM g""")
def image_folder_run(spark, d):
    """The whole batch over a folder of pictures, some of them equal, with reports written."""
    from tessera.config import make_config
    from tessera.engine import run

    python_workers(spark)

    @F.pandas_udf("binary")
    def picture(k: pd.Series) -> pd.Series:
        import numpy as np

        from tessera.functions.mutations import encode_png

        return pd.Series([encode_png(np.random.default_rng(int(x)).integers(0, 255, (40, 40, 3), dtype=np.uint8)) for x in k])

    rows = table(spark, d, "nation").select(F.concat("n_name", F.lit(".png")).alias("file_name"), F.concat(F.lit("in/"), "n_name").alias("path"), F.lit("UNIQUE").alias("status"), F.lit(1).alias("group_id"), picture(F.col("n_nationkey") % 7).alias("content"))
    folder = _folder(spark)
    sinks.export_files(rows.select("status", "group_id", "file_name", F.col("path").alias("file_path")), rows.select("path", "content"), f"{folder}/in")
    result = run(spark, f"{folder}/in", make_config({"use_background_removal": False, "color_min_pixel_count": 50}), output=f"{folder}/report")
    names = F.array_join(F.transform("members", lambda m: F.element_at(F.split(m, "/"), -1)), ",")
    return result.groups.select("group_id", names.alias("members"), "confidence", "match_type")


@query("""WITH s AS (SELECT s_suppkey AS seq, 'up' || (s_nationkey % 4) || '.png' AS name FROM supplier), n AS (SELECT seq, name, row_number() OVER (PARTITION BY name ORDER BY seq) - 1 AS k FROM s)
SELECT CASE WHEN k = 0 THEN name ELSE k || '_' || name END AS file_name, md5(seq::VARCHAR) AS digest FROM n""")
def staged_uploads(spark, d):
    """Uploads of equal names staged side by side, then listed."""
    folder = _folder(spark)
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("seq"), F.concat(F.lit("up"), F.col("s_nationkey") % 4, F.lit(".png")).alias("name"))
    files.stage_files(rows.withColumn("content", F.col("seq").cast("string").cast("binary")), folder)
    return files.discover(spark, folder, (".png",)).select(base_name("path").alias("file_name"), F.md5("content").alias("digest"))


@query("SELECT s_suppkey || '.bin' AS file_name, sha256((s_suppkey % 7)::VARCHAR) AS content_hash FROM supplier")
def incremental_digests(spark, d):
    """Files streamed into the feature table by their digests, twice, with nothing added the second time."""
    from tessera.streaming.incremental import digest_stream, feature_sink

    folder = _folder(spark)
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(F.concat_ws("/", F.lit(f"{folder}/in"), F.concat(k.cast("string"), F.lit(".bin"))).alias("target"), (k % 7).cast("string").cast("binary").alias("content"))
    sinks.copy_files(rows)
    schema = spark.read.format("binaryFile").load(f"{folder}/in").schema
    for turn in range(2):
        stream = spark.readStream.format("binaryFile").schema(schema).load(f"{folder}/in")
        work = digest_stream(stream).writeStream.foreachBatch(feature_sink(f"{folder}/features")).option("checkpointLocation", f"{folder}/state{turn}").trigger(availableNow=True).start()
        work.awaitTermination()
    return spark.read.parquet(f"{folder}/features").select(base_name("file_path").alias("file_name"), "content_hash")


@query("SELECT event_type, user_id::BIGINT AS user_id FROM events GROUP BY ALL")
def stream_dedup(spark, d):
    """The first event of each kind and user of a stream, inside a watermark that spans the table."""
    from tessera.streaming.incremental import dedup_stream

    folder = _folder(spark)
    table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", F.concat_ws("/", "event_type", "user_id").alias("key")).write.parquet(f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").schema
    rows = dedup_stream(spark.readStream.schema(schema).parquet(f"{folder}/in"), "key", "ts", "100000 hours")
    work = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    work.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out").select("event_type", F.col("user_id").cast("long").alias("user_id"))
