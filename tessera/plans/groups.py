"""Queries of constrained groups, evaluation joins, feature tables and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import columns as c
from tessera.operators import catalogue, cluster, evaluate, features, pairs, reports
from tessera.plans.registry import query
from tessera.runtime import materialize, table

#: Triples of parts (3 k, 3 k + 1, 3 k + 2) with two or three edges, some under the floor of 45, some pairs forbidden, and exact copies of some parts.
TRIPLES = """n AS (SELECT DISTINCT p_partkey // 3 AS c FROM part),
raw AS (SELECT c, 3 * c + x AS a, 3 * c + y AS b FROM n, (VALUES (0, 1), (1, 2), (0, 2)) AS e(x, y) WHERE x <> 0 OR y <> 2 OR c % 2 = 0),
e AS (SELECT c, a, b, (40 + (a * 7 + b * 13) % 60)::INT AS confidence FROM raw),
banned AS (SELECT DISTINCT c, 3 * c + c % 2 AS a, 3 * c + 1 + c % 2 AS b FROM n WHERE c % 5 = 0),
strong AS (SELECT * FROM e WHERE confidence >= 45),
best AS (SELECT c, arg_max({'a': a, 'b': b}, (confidence, a, b)) AS top, count(*) AS links FROM strong GROUP BY 1),
shape AS (SELECT best.*, banned.a AS x, banned.b AS y FROM best LEFT JOIN banned USING (c)),
parts AS (SELECT c, unnest(CASE WHEN links >= 2 AND x IS NULL THEN [3 * c, 3 * c + 1, 3 * c + 2] WHEN x = top.a AND y = top.b THEN [] ELSE [top.a, top.b] END) AS node FROM shape),
placed AS (SELECT coalesce('t' || parts.c, 's' || node) AS part, node FROM (SELECT DISTINCT unnest([3 * c, 3 * c + 1, 3 * c + 2]) AS node FROM n) LEFT JOIN parts USING (node)),
every AS (SELECT part, node FROM placed UNION ALL SELECT part, node + 10000000 FROM placed WHERE node % 10 = 0),
inner_ AS (SELECT p.part, max(e.confidence) AS confidence, 2 AS rank FROM e JOIN placed p ON p.node = e.a JOIN placed q ON q.node = e.b AND q.part = p.part GROUP BY 1
UNION ALL SELECT part, 100, 3 FROM placed WHERE node % 10 = 0),"""
GROUPED = f"""WITH {TRIPLES} top AS (SELECT part, max(confidence) AS confidence, max(rank) AS rank FROM inner_ GROUP BY 1),
g AS (SELECT part, list_sort(list(node)) AS members, count(*) AS group_size, min(node) AS representative FROM every GROUP BY 1 HAVING count(*) >= 2),
numbered AS (SELECT row_number() OVER (ORDER BY confidence DESC, group_size DESC, representative) AS group_id, members, confidence, CASE rank WHEN 3 THEN 'exact' ELSE 'near_exact' END AS match_type, representative, group_size FROM g JOIN top USING (part))"""


def _triples(spark, d):
    """(edges, rejected) as TRIPLES has them."""
    k = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 3).alias("c")).distinct()
    ends = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 1), (1, 2), (0, 2))])
    e = k.select("c", F.explode(ends).alias("e")).where("e.x <> 0 or e.y <> 2 or c % 2 = 0").select((3 * F.col("c") + F.col("e.x")).alias("a"), (3 * F.col("c") + F.col("e.y")).alias("b"))
    e = e.select("a", "b", (40 + (F.col("a") * 7 + F.col("b") * 13) % 60).cast("int").alias("confidence"), F.lit("near_exact").alias("match_type"))
    nodes = k.select(F.explode(F.array(*[3 * F.col("c") + i for i in range(3)])).alias("a")).where("a % 10 = 0")
    copies = nodes.select("a", (F.col("a") + 10_000_000).alias("b"), F.lit(100).alias("confidence"), F.lit("exact").alias("match_type"))
    banned = k.where("c % 5 = 0").select((3 * F.col("c") + F.col("c") % 2).alias("a"), (3 * F.col("c") + 1 + F.col("c") % 2).alias("b"))
    return e.unionByName(copies), banned


@query(f"{GROUPED} SELECT group_id::BIGINT AS group_id, array_to_string(members, ',') AS members, confidence::INT AS confidence, match_type FROM numbered")
def constrained_triples(spark, d):
    """Groups under cannot-link pairs, floor and density, where SQL can tell each outcome."""
    edges, banned = _triples(spark, d)
    found = cluster.build_groups(edges, banned)
    return found.select("group_id", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), "confidence", "match_type")


@query(f"{GROUPED}, m AS (SELECT group_id, unnest(members) AS node FROM numbered) SELECT group_id::BIGINT AS group_id, x.node AS a, y.node AS b FROM m x JOIN m y USING (group_id) WHERE x.node < y.node")
def member_pairs(spark, d):
    edges, banned = _triples(spark, d)
    members = materialize(cluster.group_members(edges, banned), "members")
    found = evaluate.member_pairs(members, "group_id", "file_path")
    return found.join(members.select(F.col("file_path").alias("a"), "group_id"), "a").select("group_id", "a", "b")


@query(f"""{GROUPED}, m AS (SELECT group_id, unnest(members) AS node FROM numbered)
SELECT e.a AS image_a, e.b AS image_b, confidence >= 60 AS is_duplicate, 'c' || (c % 3) AS category, coalesce(x.group_id = y.group_id, false) AS same FROM e LEFT JOIN m x ON x.node = e.a LEFT JOIN m y ON y.node = e.b""")
def judged_pairs(spark, d):
    edges, banned = _triples(spark, d)
    edges = materialize(edges, "edges")
    members = cluster.group_members(edges, banned).select(F.col("file_path").alias("file_name"), "group_id")
    near = edges.where("match_type = 'near_exact'")
    truth = near.select(F.col("a").alias("image_a"), F.col("b").alias("image_b"), (F.col("confidence") >= 60).alias("is_duplicate"), F.concat(F.lit("c"), (F.floor(F.col("a") / 3) % 3).cast("string")).alias("category"))
    return evaluate.judged_pairs(truth, members).select("image_a", "image_b", "is_duplicate", "category", "same")


@query("""SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, max(l_linenumber * 10)::INT AS confidence, max(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END)::INT AS rank
FROM lineitem GROUP BY 1, 2""")
def best_edges(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", cluster.TYPES[0]).when(F.col("l_returnflag") == "N", cluster.TYPES[1]).otherwise(cluster.TYPES[2])
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), (F.col("l_linenumber") * 10).alias("confidence"), kind.alias("match_type"))
    return cluster.best_edges(rows)


@query("""WITH k AS (SELECT 'user' || user_id AS file_path, event_type AS content_hash, event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS value, CASE WHEN event_id % 2 = 0 THEN props END AS props FROM events)
SELECT file_path, content_hash, arg_max(value, event_id) FILTER (value IS NOT NULL) AS value, arg_max(props, event_id) FILTER (props IS NOT NULL) AS props, max(event_id) AS processed_at FROM k GROUP BY ALL""")
def feature_upsert(spark, d):
    rows = table(spark, d, "events").select(
        F.concat(F.lit("user"), "user_id").alias("file_path"), F.col("event_type").alias("content_hash"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("props"), F.col("event_id").alias("processed_at"),
    )
    return features.upsert(rows.where("processed_at % 5 < 3"), rows.where("processed_at % 5 >= 3"))


@query("SELECT c_nationkey AS name, c_custkey AS seq, CASE WHEN row_number() OVER w = 1 THEN c_nationkey::VARCHAR ELSE (row_number() OVER w - 1) || '_' || c_nationkey END AS staged FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)")
def stage_names(spark, d):
    from tessera.sources.files import stage_names as staged

    return staged(table(spark, d, "customer").select(F.col("c_nationkey").alias("name"), F.col("c_custkey").alias("seq")))


LINKS = """CASE p_partkey % 6 WHEN 0 THEN 'https://drive.google.com/drive/folders/F' || p_partkey || '_x?usp=sharing' WHEN 1 THEN ' https://drive.google.com/file/d/D-' || p_partkey || '/view ' WHEN 2 THEN 'https://drive.google.com/open?id=I' || p_partkey
WHEN 3 THEN 'abcdefghijklmnopqrstuvwxyz' || p_partkey WHEN 4 THEN 'https://www.kaggle.com/datasets/me' || p_partkey || '/some-set?a=1' ELSE 'https://box.example.com/folders/f' || p_partkey || '/a.zip?dl=0' END"""


@query(f"""WITH l AS (SELECT p_partkey, p_partkey % 6 AS k, {LINKS} AS url FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'F' || p_partkey || '_x' WHEN 1 THEN 'D-' || p_partkey WHEN 2 THEN 'I' || p_partkey WHEN 3 THEN url END AS id, k = 0 AS is_folder,
CASE WHEN k = 5 THEN replace(url, 'dl=0', 'dl=1') ELSE url END AS direct, CASE WHEN k = 4 THEN 'me' || p_partkey || '/some-set' END AS slug FROM l""")
def link_parsers(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.expr(LINKS).alias("url"))
    found = rows.select("p_partkey", c.drive_link("url").alias("link"), c.direct_download("url").alias("direct"), F.when(F.col("url").contains("datasets/"), c.dataset_slug("url")).alias("slug"))
    return found.select("p_partkey", "link.id", "link.is_folder", "direct", "slug")


@query("""SELECT p_partkey, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html, CASE WHEN p_size % 2 = 0 THEN 'Größe' ELSE 'size' END AS label,
lower(trim(CASE p_size % 3 WHEN 0 THEN ' True ' WHEN 1 THEN 'false' ELSE 'yes' END)) = 'true' AS flag FROM (SELECT *, p_brand || ' <b>&"''' || p_type AS t FROM part)""")
def text_functions(spark, d):
    rows = table(spark, d, "part")
    flag = F.when(F.col("p_size") % 3 == 0, " True ").when(F.col("p_size") % 3 == 1, "false").otherwise("yes")
    language = F.when(F.col("p_size") % 2 == 0, "de").otherwise("fr")
    return rows.select("p_partkey", c.html_escape(F.concat("p_brand", F.lit(" <b>&\"'"), "p_type")).alias("html"), c.label(language, en="size", de="Größe").alias("label"), c.truth_flag(flag).alias("flag"))


@query(r"SELECT p_partkey, lower(regexp_extract(n, '(\.[^./]+)$', 1)) AS suffix, regexp_extract(n, '([^/]*)$', 1) AS base, lower(regexp_extract(n, '(\.[^./]+)$', 1)) IN ('.jpg', '.png') AS supported FROM (SELECT p_partkey, 'a.b/' || p_brand || '/' || p_partkey || CASE p_size % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.tar.gz' ELSE '' END AS n FROM part)")
def path_functions(spark, d):
    end = F.when(F.col("p_size") % 4 == 0, ".JPG").when(F.col("p_size") % 4 == 1, ".png").when(F.col("p_size") % 4 == 2, ".tar.gz").otherwise("")
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("a.b/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), end).alias("n"))
    return rows.select("p_partkey", c.suffix("n").alias("suffix"), c.base_name("n").alias("base"), c.suffix("n").isin(".jpg", ".png").alias("supported"))


@query("""SELECT s_suppkey, abs(w / h - v / g) / greatest(w / h, v / g) <= 0.15 AS close FROM (SELECT s_suppkey, (20 + s_suppkey % 17)::DOUBLE AS w, (20 + s_suppkey % 13)::DOUBLE AS h, (25 + s_suppkey % 11)::DOUBLE AS v, 30::DOUBLE AS g FROM supplier)""")
def aspect_filter(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", c.aspect_ok(20 + k % 17, 20 + k % 13, 25 + k % 11, F.lit(30)).alias("close"))


@query("""WITH v AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / n * x::DOUBLE / n)), 6)::DOUBLE AS norm, round(embedding[1]::DOUBLE * 3 / (3 * n), 6)::DOUBLE + 0.0 AS first FROM v""")
def unit_vectors(spark, d):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    rows = table(spark, d, "embeddings").select("vec_id", c.l2_normalise(tripled).alias("v"))
    return rows.select("vec_id", F.round(c.dot("v", "v"), 6).alias("norm"), (F.round(F.get("v", F.lit(0)), 6) + 0.0).alias("first"))


@query("SELECT o_orderpriority AS class FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM', '5-LOW') GROUP BY 1 ORDER BY count(*), CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END LIMIT 1")
def smallest_class(spark, d):
    return spark.createDataFrame([(catalogue.smallest_class(table(spark, d, "orders"), "o_orderpriority", ["5-LOW", "1-URGENT", "3-MEDIUM"]),)], "class string")


@query("""WITH r AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'hash' ELSE 'embedding' END AS stage, 'p' || l_orderkey AS path_a, 'q' || l_linenumber AS path_b, CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS color_distance FROM lineitem)
SELECT unnest(list_slice(list(path_a || ' ' || path_b || ' ' || coalesce(round(color_distance, 1)::VARCHAR, 'none') ORDER BY stage, path_a, path_b), 1, 50)) AS pair FROM r""")
def rejected_sample(spark, d):
    rows = table(spark, d, "lineitem")
    stage = F.when(F.col("l_linenumber") % 2 == 0, "hash").otherwise("embedding")
    far = F.when(F.col("l_quantity") > 45, F.lit(float("inf"))).otherwise(F.col("l_quantity"))
    pairs_ = rows.select(stage.alias("stage"), F.concat(F.lit("p"), "l_orderkey").alias("path_a"), F.concat(F.lit("q"), "l_linenumber").alias("path_b"), far.alias("color_distance"))
    sample = reports.telemetry({"n": 1}, pairs_).select(F.explode("rejected_pairs").alias("r"))
    return sample.select(F.concat_ws(" ", "r.path_a", "r.path_b", F.coalesce(F.round("r.color_distance", 1).cast("string"), F.lit("none"))).alias("pair"))


@query("SELECT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, l_orderkey, l_linenumber FROM lineitem")
def ordered_pairs(spark, d):
    return pairs.ordered_pairs(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), "l_orderkey", "l_linenumber"))


@query("SELECT p_type AS value, count(*)::BIGINT AS n, (row_number() OVER (ORDER BY count(*) DESC, p_type) - 1)::BIGINT AS place FROM part GROUP BY 1")
def value_counts(spark, d):
    rows = reports.value_counts(table(spark, d, "part"), "p_type").withColumnRenamed("p_type", "value")
    return rows.coalesce(1).withColumn("place", F.monotonically_increasing_id())


@query(r"WITH n AS (SELECT p_name || CASE p_partkey % 4 WHEN 0 THEN '_12' WHEN 1 THEN '_Angle3' WHEN 2 THEN '_ORIGINAL_x' ELSE ' (2)' END AS stem FROM part) SELECT trim(lower(regexp_replace(stem, '(_[0-9]+|_angle[0-9]+|_view[0-9]+|_original.*|\s*\([0-9]+\))$', '', 'i'))) AS model_id, min(stem || '.png') AS primary_file, count(*)::BIGINT AS views, md5(string_agg(stem || '.png', ',' ORDER BY stem || '.png')) AS digest FROM n GROUP BY 1")
def model_members(spark, d):
    k = F.col("p_partkey") % 4
    tail = F.when(k == 0, "_12.png").when(k == 1, "_Angle3.png").when(k == 2, "_ORIGINAL_x.png").otherwise(" (2).png")
    found = catalogue.models(table(spark, d, "part").select(F.concat("p_name", tail).alias("file_name")))
    return found.select("model_id", "primary_file", F.size("all_views").cast("long").alias("views"), F.md5(F.array_join("all_views", ",")).alias("digest"))


@query("SELECT count(DISTINCT (user_id, event_type))::BIGINT AS files, count(DISTINCT CASE WHEN event_id % 3 = 0 THEN (user_id, event_type) END)::BIGINT AS embedded FROM events")
def cached_features(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("file_path"), F.col("event_type").alias("content_hash"), F.when(F.col("event_id") % 3 == 0, F.array("value")).alias("embedding"))
    return features.count_features(rows)


@query("""WITH g AS (SELECT text, count(*) AS n, min(doc_id) AS first_ FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT 'archived' AS part, count(*)::BIGINT AS n, coalesce(sum(doc_id), 0)::BIGINT AS ids FROM documents JOIN g USING (text) WHERE g.n > 1 AND doc_id <> first_
UNION ALL SELECT 'kept', count(*)::BIGINT, coalesce(sum(doc_id), 0)::BIGINT FROM documents LEFT JOIN g USING (text) WHERE g.n IS NULL OR g.n = 1 OR doc_id = first_""")
def kept_and_archived(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.format_string("doc/%010d", "doc_id").alias("path"), F.sha2("text", 256).alias("exact_hash"), F.octet_length("text").alias("length"))
    stock = materialize(reports.inventory(docs.withColumn("sha256", F.col("exact_hash")), pairs.exact_members(docs)), "stock")
    part = lambda name, df: df.join(docs.withColumnRenamed("path", "file_path"), "file_path").agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_id"), F.lit(0)).alias("ids")).select(F.lit(name).alias("part"), "n", "ids")
    return part("kept", reports.kept(stock)).unionByName(part("archived", reports.archived(stock)))


@query("SELECT s_suppkey, round(s_suppkey % 100 + 0.5, 3)::DOUBLE AS l, 0.25::DOUBLE AS share, s_suppkey % 5 = 0 AS broken FROM supplier")
def palette_json(spark, d):
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select("s_suppkey", F.array(F.array(k % 100 + 0.5, F.lit(1.0), F.lit(-2.5), F.lit(0.25))).alias("palette"))
    text = F.when(k % 5 == 0, "no json").otherwise(features.encode_palette("palette"))
    back = rows.withColumn("text", text).withColumn("back", features.decode_palette("text"))
    first = F.get(F.coalesce("back", "palette"), F.lit(0))
    return back.select("s_suppkey", F.round(F.get(first, F.lit(0)), 3).alias("l"), F.get(first, F.lit(3)).alias("share"), F.col("back").isNull().alias("broken"))
