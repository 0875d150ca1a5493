"""Registered queries over the driver's tables, each with its SQL equivalent where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import columns as c
from tessera.operators import catalogue, cluster, evaluate, pairs, reports
from tessera.operators.features import split_resume
from tessera.operators.graph import connected_components as connected_components_of
from tessera.plans.registry import ORACLES, QUERIES, query
from tessera.runtime import materialize, table

__all__ = ["ORACLES", "QUERIES"]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.format_string("doc/%010d", "doc_id").alias("path"), F.sha2("text", 256).alias("exact_hash"), F.octet_length("text").alias("length"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Members of the exact groups of documents, numbered by size and first member."""
    return pairs.exact_members(_docs(spark, d))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _sigs(spark: SparkSession, d: str) -> DataFrame:
    """Sign bits of a vector as one signature, and of its neighbour differences as the other."""
    return pairs.vector_signatures(_vectors(spark, d))


DOCS = "docs AS (SELECT doc_id, format('doc/{:010d}', doc_id) AS path, sha256(text) AS exact_hash, octet_length(encode(text)) AS length FROM documents)"
GROUPS = f"""{DOCS}, raw AS (SELECT exact_hash, list_sort(list(DISTINCT path)) AS members FROM docs WHERE exact_hash IS NOT NULL GROUP BY 1 HAVING count(DISTINCT path) >= 2),
grp AS (SELECT row_number() OVER (ORDER BY len(members) DESC, members[1]) AS group_id, members, len(members) AS group_size FROM raw),
member AS (SELECT group_id, unnest(members) AS path, unnest(range(len(members))) AS nth, group_size FROM grp)"""
SIGS = """bits AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS s,
 list_transform(range(1, 64), lambda i: CASE WHEN embedding[i + 1] > embedding[i] THEN 1 ELSE 0 END) AS t FROM embeddings),
sigs AS (SELECT id, (array_to_string(s, ''))::BIT AS p, ('0' || array_to_string(t, ''))::BIT AS d FROM bits)"""
SIMS = "sims AS (SELECT a.vec_id AS i, b.vec_id AS j, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM embeddings a, embeddings b)"
TOPK = f"{SIMS}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY similarity DESC, j) AS r FROM sims) WHERE r <= 10)"
HAMMING = f"WITH {SIGS} SELECT a.id AS a, b.id AS b, bit_count(xor(a.p, b.p))::INT AS p_dist, bit_count(xor(a.d, b.d))::INT AS d_dist FROM sigs a, sigs b WHERE a.id < b.id AND bit_count(xor(a.p, b.p)) <= 18 AND bit_count(xor(a.d, b.d)) <= 22"


@query(f"WITH {GROUPS} SELECT exact_hash, members[1] AS representative, len(members)::BIGINT AS group_size FROM raw")
def exact_groups(spark, d):
    return pairs.exact_groups(_docs(spark, d)).select("exact_hash", "representative", "group_size")


@query("SELECT md5(text) AS digest, count(*)::BIGINT AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def md5_groups(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(c.content_digest("text", "md5").alias("digest")).agg(F.count("*").alias("n")).where("n > 1")


@query(f"WITH {DOCS} SELECT a.path AS a, b.path AS b, 100 AS confidence FROM docs a JOIN docs b USING (exact_hash) WHERE a.path < b.path")
def exact_pairs(spark, d):
    return pairs.exact_pairs(_docs(spark, d)).select("a", "b", "confidence")


@query(f"WITH {DOCS} SELECT min(path) AS path, exact_hash FROM docs WHERE exact_hash IS NOT NULL GROUP BY exact_hash")
def canonical_rows(spark, d):
    return pairs.canonical_rows(_docs(spark, d)).select("path", "exact_hash")


@query(f"WITH {SIGS} SELECT id, lower(lpad(to_hex(p::BIGINT), 16, '0')) AS p_hex, lower(lpad(to_hex(d::BIGINT), 16, '0')) AS d_hex FROM sigs")
def embedding_signature(spark, d):
    """The signatures of _sigs as scalar expressions."""
    step = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.get("embedding", i + 1) > F.get("embedding", i))
    return _vectors(spark, d).select("id", c.to_hex(c.sign_bits("embedding", 0)).alias("p_hex"), c.to_hex(c.pack_bits(step)).alias("d_hex"))


@query(HAMMING)
def hamming_pairs_theta(spark, d):
    return pairs.hamming_theta(_sigs(spark, d), 18, 22)


@query(HAMMING)
def hamming_pairs_banded(spark, d):
    return pairs.hamming_join(_sigs(spark, d), 18, 22)


@query(f"WITH {TOPK} SELECT i, j, r::INT AS rank, round(similarity, 4) AS similarity FROM top")
def cosine_topk(spark, d):
    order = Window.partitionBy("i").orderBy(F.desc("similarity"), "j")
    return pairs.cosine_topk(_vectors(spark, d), 10).select("i", "j", F.row_number().over(order).alias("rank"), F.round("similarity", 4).alias("similarity"))


@query(f"WITH {TOPK} SELECT DISTINCT least(i, j) AS a, greatest(i, j) AS b, round(similarity, 4) AS similarity FROM top WHERE i <> j AND similarity >= 0.4")
def cosine_candidates(spark, d):
    return pairs.cosine_candidates(_vectors(spark, d), 10, 0.4).select("a", "b", F.round("similarity", 4).alias("similarity"))


@query()
def ivf_candidates(spark, d):
    """Approximate: the vectors are spread evenly, so two thirds of the cells are needed for a recall of 0.9 (tests/test_queries.py)."""
    return pairs.ivf_candidates(_vectors(spark, d), 10, 0.4, nlist=30, nprobe=20)


@query(f"WITH {TOPK} SELECT DISTINCT least(i, j) AS a, greatest(i, j) AS b, round(similarity, 4) AS similarity FROM top WHERE i <> j AND similarity >= 0.4")
def ivf_all_cells(spark, d):
    """With every cell probed the index gives the exact result."""
    return pairs.ivf_candidates(_vectors(spark, d), 10, 0.4, nlist=30, nprobe=30).select("a", "b", F.round("similarity", 4).alias("similarity"))


@query("SELECT b.vec_id AS id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity FROM (SELECT * FROM embeddings WHERE vec_id = 0) a, embeddings b ORDER BY list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id LIMIT 5")
def knn_single(spark, d):
    v = _vectors(spark, d)
    first = v.where("id = 0").select("embedding").first()
    return pairs.knn_single(v, list(first["embedding"]) if first else [0.0] * 64, 5, -1.0).select("id", F.round("similarity", 4).alias("similarity"))


@query(f"WITH h AS ({HAMMING}) SELECT a, b, greatest(0, least(100, round_even(95 - (p_dist + d_dist) / 2.0 * 2.0, 0)))::INT AS confidence, CASE WHEN p_dist <= 18 AND d_dist <= 18 THEN 'strict' ELSE 'deferred' END AS tier FROM h")
def hash_confidence(spark, d):
    found = pairs.tier_split(pairs.hamming_join(_sigs(spark, d), 18, 22), 18)
    return found.select("a", "b", c.hash_confidence("p_dist", "d_dist").alias("confidence"), "tier")


@query("SELECT l_orderkey, l_linenumber, greatest(0, least(100, round_even(85.0 * l_discount * 10 * (0.7 + 0.3 * greatest(0.0, 1.0 - l_quantity / 18.0)), 0)))::INT AS confidence FROM lineitem")
def embedding_confidence(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", c.embedding_confidence(F.col("l_discount") * 10, "l_quantity").alias("confidence"))


@query("SELECT CASE WHEN p_size * 2 >= 90 THEN 'high' WHEN p_size * 2 >= 70 THEN 'medium' ELSE 'low' END AS band, count(*)::BIGINT AS n FROM part GROUP BY 1")
def confidence_bands(spark, d):
    return table(spark, d, "part").groupBy(c.confidence_band(F.col("p_size") * 2).alias("band")).agg(F.count("*").alias("n"))


@query(f"""WITH {TOPK}, near AS (SELECT DISTINCT least(i, j) AS a, greatest(i, j) AS b, similarity FROM top WHERE i <> j AND similarity >= 0.35), h AS ({HAMMING})
SELECT n.a, n.b, greatest(round_even(100 * n.similarity, 0)::INT, CASE WHEN h.a IS NULL THEN 0 ELSE greatest(0, least(100, round_even(95 - (p_dist + d_dist) / 2.0 * 2.0, 0)))::INT END) AS confidence, CASE WHEN h.a IS NULL THEN 'embedding_color_verified' ELSE 'near_exact' END AS match_type FROM near n LEFT JOIN h ON h.a = n.a AND h.b = n.b""")
def deferred_upgrade(spark, d):
    """Of the hash pairs only those among the neighbours can change a row, so only these are looked up."""
    near = pairs.cosine_candidates(_vectors(spark, d), 10, 0.35).select("a", "b", F.bround(100 * F.col("similarity"), 0).cast("int").alias("confidence"))
    near = materialize(near, "near")
    h = pairs.hamming_among(near, _sigs(spark, d), 18, 22).select("a", "b", c.hash_confidence("p_dist", "d_dist").alias("confidence"))
    return pairs.upgrade_deferred(near, h)


@query(f"WITH {TOPK}, near AS (SELECT DISTINCT least(i, j) AS a, greatest(i, j) AS b FROM top WHERE i <> j AND similarity >= 0.35), h AS ({HAMMING}) SELECT n.a, n.b, (n.a % 2 = 0) AS was_rejected FROM near n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.a = n.a AND h.b = n.b)")
def matched_skip(spark, d):
    near = materialize(pairs.cosine_candidates(_vectors(spark, d), 10, 0.35).select("a", "b"), "near")
    return pairs.skip_decided(near, pairs.hamming_join(_sigs(spark, d), 18, 22), near.where("a % 2 = 0"))


@query(f"""WITH RECURSIVE {TOPK}, near AS (SELECT DISTINCT least(i, j) AS a, greatest(i, j) AS b FROM top WHERE i <> j AND similarity >= 0.4),
e AS (SELECT a, b FROM near UNION SELECT b, a FROM near), reach(node, other) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.other = e.a)
SELECT node, min(other) AS component FROM reach GROUP BY node""")
def connected_components(spark, d):
    return connected_components_of(pairs.cosine_candidates(_vectors(spark, d), 10, 0.4).select("a", "b"))


@query()
def constrained_groups(spark, d):
    near = materialize(pairs.cosine_candidates(_vectors(spark, d), 10, 0.35), "near")
    edges = near.select("a", "b", F.bround(100 * F.col("similarity"), 0).cast("int").alias("confidence"), F.lit("near_exact").alias("match_type"))
    return cluster.build_groups(edges, near.where("(a + b) % 7 = 0").select("a", "b"), floor=30)


@query(f"WITH {GROUPS} SELECT group_id::BIGINT AS group_id, path AS file_path, regexp_extract(path, '([^/]*)$', 1) AS file_name, 100 AS confidence, 'exact' AS match_type, group_size::BIGINT AS group_size FROM member")
def group_report(spark, d):
    return reports.group_report(_members(spark, d))


@query(f"""WITH {GROUPS} SELECT regexp_extract(docs.path, '([^/]*)$', 1) AS file_name, CASE WHEN nth IS NULL THEN 'UNIQUE' WHEN nth = 0 THEN 'CANONICAL_MASTER' ELSE 'DUPLICATE' END AS status,
CASE WHEN nth IS NULL THEN 'KEEP_UNIQUE' WHEN nth = 0 THEN 'KEEP_MASTER' ELSE 'ARCHIVE_DUPLICATE' END AS recommended_action, group_id::BIGINT AS group_id, coalesce(group_size, 1)::BIGINT AS group_size,
CASE WHEN nth IS NULL THEN NULL ELSE 100 END AS confidence, CASE WHEN nth IS NULL THEN 'none' ELSE 'exact' END AS match_type, coalesce(round_even(length / 1024.0, 1), 0.0)::DOUBLE AS file_size_kb, exact_hash AS sha256_hash, docs.path AS file_path FROM docs LEFT JOIN member USING (path)""")
def inventory(spark, d):
    return reports.inventory(_docs(spark, d).withColumnRenamed("exact_hash", "sha256"), _members(spark, d))


@query(f"""WITH {GROUPS}, t AS (SELECT (SELECT count(*) FROM docs) AS total, (SELECT count(*) FROM grp) AS g, (SELECT count(*) FROM member) AS m)
SELECT unnest(['total_images', 'duplicate_groups', 'images_in_groups', 'unique_images', 'redundant_images', 'groups_exact', 'groups_near_exact', 'groups_embedding_color_verified']) AS metric,
unnest([total::VARCHAR, g::VARCHAR, m::VARCHAR, (total - m)::VARCHAR, (m - g)::VARCHAR, g::VARCHAR, '0', '0']) AS value FROM t""")
def summary(spark, d):
    return reports.summary(_docs(spark, d), _members(spark, d))


@query(f"WITH {GROUPS} SELECT (SELECT count(*) FROM docs)::BIGINT AS total, (SELECT count(*) FROM member)::BIGINT AS grouped, ((SELECT count(*) FROM docs) - (SELECT count(*) FROM member))::BIGINT AS \"unique\", round(100.0 * (SELECT count(*) FROM member) / (SELECT count(*) FROM docs), 1)::DOUBLE AS overlap_pct, 0::BIGINT AS blocked")
def kpis(spark, d):
    return reports.kpis(_docs(spark, d), _members(spark, d), spark.createDataFrame([], "a long"))


@query(f"WITH {GROUPS} SELECT group_id::BIGINT AS group_id, 100 AS confidence, 'exact' AS match_type, group_size::BIGINT AS group_size FROM grp ORDER BY group_id LIMIT 10 OFFSET 10")
def page_of_groups(spark, d):
    return reports.page(reports.group_report(_members(spark, d)), 1, 10, ["high"], ["exact"])


@query(f"WITH {DOCS} SELECT path FROM docs ORDER BY path LIMIT 25")
def sample_first_n(spark, d):
    return _docs(spark, d).select("path").orderBy(F.split("path", "/")).limit(25)


def _predicted(spark, d):
    """Neighbour pairs as predictions, equal labels among close pairs as truth."""
    near = materialize(pairs.cosine_candidates(_vectors(spark, d), 10, 0.35), "near")
    label = lambda s: _vectors(spark, d).select(F.col("id").alias(s), F.col("label").alias(f"l_{s}"))
    return near.join(label("a"), "a").join(label("b"), "b")


PREDICTED = f"WITH {TOPK}, near AS (SELECT DISTINCT least(i, j) AS a, greatest(i, j) AS b, similarity FROM top WHERE i <> j AND similarity >= 0.35), lab AS (SELECT n.*, x.label AS l_a, y.label AS l_b FROM near n JOIN embeddings x ON x.vec_id = n.a JOIN embeddings y ON y.vec_id = n.b)"


@query(f"""{PREDICTED}, p AS (SELECT a, b FROM lab WHERE similarity >= 0.4), t AS (SELECT a, b FROM lab WHERE l_a = l_b),
n AS (SELECT (SELECT count(*) FROM (SELECT * FROM p INTERSECT SELECT * FROM t)) AS tp, (SELECT count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM t)) AS fp, (SELECT count(*) FROM (SELECT * FROM t EXCEPT SELECT * FROM p)) AS fn),
s AS (SELECT *, CASE WHEN tp + fp > 0 THEN 100.0 * tp / (tp + fp) ELSE 100 END AS p, CASE WHEN tp + fn > 0 THEN 100.0 * tp / (tp + fn) ELSE 0 END AS r FROM n)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(p, 2)::DOUBLE AS precision, round(r, 2)::DOUBLE AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 2)::DOUBLE AS f1 FROM s""")
def pair_evaluation(spark, d):
    both = _predicted(spark, d)
    return evaluate.pairwise_scores(both.where("similarity >= 0.4").select("a", "b"), both.where("l_a = l_b").select("a", "b"))


@query(f"""{PREDICTED}, j AS (SELECT l_a = l_b AS dup, similarity >= 0.4 AS same, 'label' || (l_a % 3) AS category FROM lab),
n AS (SELECT category, grouping(category)::TINYINT AS overall, count(*) FILTER (dup AND same)::BIGINT AS tp, count(*) FILTER (NOT dup AND same)::BIGINT AS fp, count(*) FILTER (dup AND NOT same)::BIGINT AS fn, count(*) FILTER (NOT dup AND NOT same)::BIGINT AS tn FROM j GROUP BY ROLLUP (category)),
s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS r FROM n)
SELECT category, overall, tp, fp, fn, tn, round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6)::DOUBLE AS f1 FROM s""")
def confusion_by_category(spark, d):
    judged = _predicted(spark, d).select((F.col("l_a") == F.col("l_b")).alias("is_duplicate"), (F.col("similarity") >= 0.4).alias("same"), F.concat(F.lit("label"), (F.col("l_a") % 3).cast("string")).alias("category"))
    scores = [F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    return evaluate.confusion(judged).select("category", "overall", "tp", "fp", "fn", "tn", *scores)


@query(f"{PREDICTED} SELECT count(*) FILTER (l_a <> l_b)::BIGINT AS n, count(*) FILTER (l_a <> l_b AND similarity >= 0.4)::BIGINT AS false_positives, round(coalesce(count(*) FILTER (l_a <> l_b AND similarity >= 0.4) / nullif(count(*) FILTER (l_a <> l_b), 0), 0.0), 6)::DOUBLE AS rate FROM lab")
def color_fp_rate(spark, d):
    judged = _predicted(spark, d).select(F.when(F.col("l_a") != F.col("l_b"), "same_product_different_color").otherwise("same").alias("category"), (F.col("similarity") >= 0.4).alias("same"))
    return evaluate.color_fp_rate(judged).withColumn("rate", F.round("rate", 6))


@query(f"""WITH {GROUPS}, m AS (SELECT group_id, lang AS label FROM member JOIN docs USING (path) JOIN documents USING (doc_id)), a AS (SELECT group_id, label, count(*) AS n FROM m GROUP BY ALL),
g AS (SELECT group_id, sum(n) AS n, sum(n * n) AS sq, count(*) AS k FROM a GROUP BY 1), s AS (SELECT (sum(sq - n) / 2)::BIGINT AS same, (sum(n * (n - 1)) / 2 - sum(sq - n) / 2)::BIGINT AS different, count(*) FILTER (k > 1)::BIGINT AS mixed_groups FROM g)
SELECT same, different, mixed_groups, round(100.0 * same / (same + different), 2)::DOUBLE AS purity_pct FROM s""")
def class_purity(spark, d):
    members = reports.group_report(_members(spark, d)).join(_docs(spark, d).select("doc_id", F.col("path").alias("file_path")), "file_path")
    return evaluate.purity(members.join(table(spark, d, "documents").select("doc_id", F.col("lang").alias("label")), "doc_id").select("group_id", "label"))


@query("SELECT o_orderpriority AS kind, count(*)::BIGINT AS cases, count(*) FILTER ((o_orderkey % 3 = 0) = (o_custkey % 2 = 0))::BIGINT AS correct, round(100.0 * count(*) FILTER ((o_orderkey % 3 = 0) = (o_custkey % 2 = 0)) / count(*), 1)::DOUBLE AS accuracy FROM orders GROUP BY 1")
def kind_accuracy(spark, d):
    return evaluate.kind_accuracy(table(spark, d, "orders").select(F.col("o_orderpriority").alias("kind"), (F.col("o_orderkey") % 3 == 0).alias("expect_grouped"), (F.col("o_custkey") % 2 == 0).alias("grouped_together")))


RGB = "rgb AS (SELECT p_partkey, (p_partkey * 37) % 256 AS r, (p_partkey * 101) % 256 AS g, (p_partkey * 211) % 256 AS b FROM part)"


def _rgb(spark, d):
    return table(spark, d, "part").select("p_partkey", *[(F.col("p_partkey") * k % 256).alias(n) for n, k in (("r", 37), ("g", 101), ("b", 211))])


@query(f"""WITH {RGB}, lin AS (SELECT p_partkey, list_transform([r, g, b], lambda v: CASE WHEN v / 255.0::DOUBLE > 0.04045 THEN pow((v / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE v / 255.0::DOUBLE / 12.92 END) AS c FROM rgb),
xyz AS (SELECT p_partkey, [(c[1] * 0.4124564 + c[2] * 0.3575761 + c[3] * 0.1804375) / 0.95047, c[1] * 0.2126729 + c[2] * 0.7151522 + c[3] * 0.0721750, (c[1] * 0.0193339 + c[2] * 0.1191920 + c[3] * 0.9503041) / 1.08883] AS t FROM lin),
f AS (SELECT p_partkey, list_transform(t, lambda v: CASE WHEN v > 0.008856 THEN pow(v, 1.0::DOUBLE / 3.0) ELSE 7.787 * v + 16.0::DOUBLE / 116.0 END) AS f FROM xyz)
SELECT p_partkey, round(116.0 * f[2] - 16.0, 3)::DOUBLE + 0.0 AS l, round(500.0 * (f[1] - f[2]), 3)::DOUBLE + 0.0 AS a, round(200.0 * (f[2] - f[3]), 3)::DOUBLE + 0.0 AS b FROM f""")
def rgb_to_lab(spark, d):
    x, y, z = c.rgb_to_lab("r", "g", "b")
    return _rgb(spark, d).select("p_partkey", *[(F.round(v, 3) + 0.0).alias(n) for n, v in (("l", x), ("a", y), ("b", z))])


@query(f"""WITH {RGB}, m AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS span FROM rgb)
SELECT p_partkey, round(CASE WHEN span = 0 THEN 0 WHEN b = hi THEN 60.0 * ((r - g) / span::DOUBLE + 4) WHEN g = hi THEN 60.0 * ((b - r) / span::DOUBLE + 2) ELSE CASE WHEN g < b THEN 60.0 * (g - b) / span::DOUBLE + 360 ELSE 60.0 * (g - b) / span::DOUBLE END END, 4)::DOUBLE AS h,
round(CASE WHEN hi > 0 THEN span / hi::DOUBLE ELSE 0 END, 4)::DOUBLE AS s, round(hi / 255.0::DOUBLE, 4)::DOUBLE AS v FROM m""")
def rgb_to_hsv(spark, d):
    h, s, v = c.rgb_to_hsv("r", "g", "b")
    return _rgb(spark, d).select("p_partkey", F.round(h, 4).alias("h"), F.round(s, 4).alias("s"), F.round(v, 4).alias("v"))


@query("SELECT l_returnflag, round(median(l_extendedprice), 4)::DOUBLE AS p50, round(quantile_cont(l_extendedprice, 0.8), 4)::DOUBLE AS p80, round(quantile_cont(l_extendedprice, 0.85), 4)::DOUBLE AS p85 FROM lineitem GROUP BY 1")
def percentile_spread(spark, d):
    at = lambda q: F.round(F.percentile("l_extendedprice", q), 4)
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(at(0.5).alias("p50"), at(0.8).alias("p80"), at(0.85).alias("p85"))


@query(r"WITH n AS (SELECT p_name || CASE p_partkey % 4 WHEN 0 THEN '_12' WHEN 1 THEN '_Angle3' WHEN 2 THEN '_ORIGINAL_x' ELSE ' (2)' END AS name FROM part) SELECT trim(lower(regexp_replace(name, '(_[0-9]+|_angle[0-9]+|_view[0-9]+|_original.*|\s*\([0-9]+\))$', '', 'i'))) AS stem, count(*)::BIGINT AS n FROM n GROUP BY 1")
def model_stem_groups(spark, d):
    tail = F.when(F.col("p_partkey") % 4 == 0, "_12").when(F.col("p_partkey") % 4 == 1, "_Angle3").when(F.col("p_partkey") % 4 == 2, "_ORIGINAL_x").otherwise(" (2)")
    return table(spark, d, "part").groupBy(c.model_stem(F.concat("p_name", tail)).alias("stem")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN p_partkey % 3 = 0 THEN 'item' ELSE 'chair_' || lower(replace(p_brand, '#', '_')) END AS category, format('group_{:04d}_{}', p_size, CASE WHEN p_partkey % 3 = 0 THEN 'item' ELSE 'chair' END) AS folder, count(*)::BIGINT AS n FROM (SELECT p_partkey, p_size, regexp_replace(p_brand, '[^a-zA-Z]', '', 'g') AS p_brand FROM part) GROUP BY ALL")
def category_prefix(spark, d):
    brand = F.lower(F.regexp_replace("p_brand", "[^a-zA-Z]", ""))
    name = F.when(F.col("p_partkey") % 3 == 0, F.lit("plain.png")).otherwise(F.concat(F.lit("chair_"), brand, F.lit("_model_1.png")))
    short = F.when(F.col("p_partkey") % 3 == 0, "item").otherwise("chair")
    return table(spark, d, "part").select(c.category_prefix(name).alias("category"), c.group_folder("p_size", short).alias("folder")).groupBy("category", "folder").agg(F.count("*").alias("n"))


@query("SELECT doc_id % 3 = 0 AS cached, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def resume_split(spark, d):
    rows = _docs(spark, d).select(F.col("path").alias("file_path"), F.col("exact_hash").alias("content_hash"), "doc_id")
    have, missing = split_resume(rows, rows.where("doc_id % 3 = 0"))
    return have.select(F.lit(True).alias("cached")).unionByName(missing.select(F.lit(False).alias("cached"))).groupBy("cached").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY 1")
def distinct_members(spark, d):
    return table(spark, d, "events").select("event_type", "user_id").distinct().groupBy("event_type").agg(F.count("user_id").alias("users"))


def _crops(spark: SparkSession, d: str) -> DataFrame:
    """Signatures with crop signatures that are the next vector's, one bit changed."""
    s = _sigs(spark, d)
    after = s.select((F.col("id") - 1).alias("id"), F.col("p").bitwiseXOR(F.lit(4).cast("bigint")).alias("crop_p"), F.col("d").alias("crop_d"))
    return s.join(after, "id", "left")


@query(f"""WITH {SIGS}, n AS (SELECT a.id, xor(b.p, 4::BIGINT::BIT) AS crop_p, b.d AS crop_d FROM sigs a JOIN sigs b ON b.id = a.id + 1),
hit AS (SELECT least(n.id, s.id) AS a, greatest(n.id, s.id) AS b, bit_count(xor(crop_p, s.p))::INT AS p_dist, bit_count(xor(crop_d, s.d))::INT AS d_dist FROM n, sigs s WHERE n.id <> s.id AND bit_count(xor(crop_p, s.p)) <= 2 AND bit_count(xor(crop_d, s.d)) <= 2)
SELECT a, b, arg_min(p_dist, (p_dist + d_dist) * 100 + p_dist) AS p_dist, arg_min(d_dist, (p_dist + d_dist) * 100 + p_dist) AS d_dist FROM hit GROUP BY a, b""")
def crop_style_asymmetric(spark, d):
    return pairs.crop_join(_crops(spark, d))


@query(f"""WITH {GROUPS}, j AS (SELECT count(*) AS total_images, (SELECT count(*) FROM grp) AS groups_found, (SELECT count(*) FROM member) AS images_in_groups FROM docs)
SELECT total_images::INT AS total_images, groups_found::INT AS groups_found, images_in_groups::INT AS images_in_groups, 0 AS rejected FROM j""")
def telemetry_counters(spark, d):
    members = _members(spark, d)
    counts = {"total_images": _docs(spark, d).count(), "groups_found": members.where("file_path = representative").count(), "images_in_groups": members.count()}
    none = spark.createDataFrame([], "stage string, path_a string, path_b string, color_distance double")
    return reports.telemetry(counts, none).select(*counts, F.size("rejected_pairs").alias("rejected"))


@query(f"WITH {GROUPS} SELECT DISTINCT regexp_extract(path, '([^/]*)$', 1) AS file_name FROM member JOIN docs USING (path) WHERE doc_id % 5 = 0")
def control_violations(spark, d):
    controls = _docs(spark, d).where("doc_id % 5 = 0").select(c.base_name("path").alias("variant_file"))
    return evaluate.violations(reports.group_report(_members(spark, d)), controls)


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    """Seeds whose stems come in pairs and whose signatures are coarse, so that both kinds of exclusion occur."""
    s = _sigs(spark, d)
    return s.select(F.format_string("%06d", "id").alias("path"), F.concat(F.lit("Model"), F.floor(F.col("id") / 3).cast("string"), F.lit("_"), F.col("id").cast("string")).alias("stem"), "p", "d")


@query(f"""WITH RECURSIVE {SIGS}, seeds AS (SELECT format('{{:06d}}', id) AS path, 'model' || (id // 3) AS stem, p, d, row_number() OVER (ORDER BY format('{{:06d}}', id)) AS i FROM sigs),
scan AS (SELECT 0::BIGINT AS i, []::STRUCT(path VARCHAR, stem VARCHAR, p BIT, d BIT)[] AS kept
UNION ALL SELECT s.i, CASE WHEN len(list_filter(scan.kept, lambda k: k.stem = s.stem OR (bit_count(xor(k.p, s.p)) <= 18 AND bit_count(xor(k.d, s.d)) <= 22))) = 0
THEN list_append(scan.kept, {{'path': s.path, 'stem': s.stem, 'p': s.p, 'd': s.d}}) ELSE scan.kept END FROM scan JOIN seeds s ON s.i = scan.i + 1)
SELECT k.path FROM (SELECT unnest(kept) AS k FROM scan WHERE i = (SELECT max(i) FROM scan))""")
def distinct_seeds(spark, d):
    return catalogue.distinct_seeds(_seeds(spark, d), 18, 22)


@query("""WITH n AS (SELECT p_partkey, p_name || format(' {:08d}', p_partkey) AS name FROM part),
r1 AS (SELECT *, row_number() OVER (PARTITION BY name LIKE '%bolt%' OR name LIKE '%widget%' ORDER BY name) AS k FROM n),
c1 AS (SELECT *, CASE WHEN name LIKE '%bolt%' OR (name LIKE '%widget%' AND k <= 40) THEN 'first' END AS c FROM r1),
r2 AS (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY c IS NULL AND name LIKE '%widget%' ORDER BY name) AS k FROM c1)
SELECT p_partkey, coalesce(c, CASE WHEN name LIKE '%cold%' THEN 'second' WHEN name LIKE '%widget%' AND k <= 40 THEN 'third' END, 'rest') AS class FROM (
 SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY c IS NULL AND name NOT LIKE '%cold%' AND name LIKE '%widget%' ORDER BY name) AS k FROM r2)""")
def capped_classes(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.format_string(" %08d", "p_partkey")).alias("name"))
    rules = [("first", ["bolt"], ["widget"]), ("second", ["cold"], []), ("third", [], ["widget"])]
    return catalogue.capped_classes(rows, "name", rules, 40, "rest").select("p_partkey", "class")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS counter FROM orders")
def running_counter(spark, d):
    return catalogue.running_counter(table(spark, d, "orders"), "o_custkey", ["o_orderkey"]).select("o_orderkey", "counter")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1)::BIGINT AS position, ((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) % 7)::INT AS turn FROM orders")
def round_robin(spark, d):
    return catalogue.round_robin(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 7).select("o_orderkey", "position", "turn")


@query("SELECT p_partkey FROM part WHERE NOT regexp_matches(upper(p_name), 'COLD|BOLT') AND NOT ((p_size, p_partkey % 4) IN ((24, 0), (10, 1)))")
def seed_filters(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("name"), F.col("p_size").alias("width"), (F.col("p_partkey") % 4).alias("height"))
    return catalogue.without_sizes(catalogue.without_marks(rows, "name", ("COLD", "BOLT")), [(24, 0), (10, 1)]).select("p_partkey")


@query("WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT count(*) FILTER (n >= 2)::BIGINT AS clusters, coalesce(sum(n) FILTER (n >= 2), 0)::BIGINT AS clustered, count(*) FILTER (n = 1)::BIGINT AS \"unique\" FROM s")
def cluster_stats(spark, d):
    return catalogue.cluster_stats(table(spark, d, "orders"), "o_custkey")


NEARBY = f"""{SIGS}, every AS (SELECT id, p, d FROM sigs UNION ALL
SELECT id + 1000000, xor(p, ((1::BIGINT << (id % 9)::INT) - 1)::BIT), xor(d, ((1::BIGINT << (id % 8)::INT) - 1)::BIT) FROM sigs)"""


@query(f"WITH {NEARBY} SELECT a.id AS a, b.id AS b, bit_count(xor(a.p, b.p))::INT AS p_dist, bit_count(xor(a.d, b.d))::INT AS d_dist FROM every a, every b WHERE a.id < b.id AND bit_count(xor(a.p, b.p)) <= 8 AND bit_count(xor(a.d, b.d)) <= 6")
def hamming_pairs_default(spark, d):
    """At the default thresholds, over the signatures and copies of them with up to eight bits flipped."""
    s = _sigs(spark, d)
    flipped = lambda c, n: F.col(c).bitwiseXOR(F.expr(f"shiftleft(1L, CAST(id % {n} AS INT)) - 1"))
    return pairs.hamming_join(s.unionByName(s.select((F.col("id") + 1_000_000).alias("id"), flipped("p", 9).alias("p"), flipped("d", 8).alias("d"))), 8, 6)


from tessera.plans import groups, pictures, trips  # noqa: E402, F401
