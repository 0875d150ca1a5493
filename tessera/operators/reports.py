"""Group report, inventory, summary and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import base_name, size_kb
from tessera.operators.cluster import TYPES


def group_report(members: DataFrame) -> DataFrame:
    """The report of members (group_id, file_path, representative, group_size, confidence, match_type)."""
    return members.select("group_id", "file_path", base_name("file_path").alias("file_name"), "confidence", "match_type", "group_size")


def inventory(images: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each of images (path, length, sha256): a group's representative is its master, others are duplicates, the rest unique."""
    rows = images.select("path", "length", "sha256").join(members, F.col("path") == F.col("file_path"), "left").drop("file_path")
    master = F.col("path") == F.col("representative")
    status = F.when(F.col("group_id").isNull(), "UNIQUE").when(master, "CANONICAL_MASTER").otherwise("DUPLICATE")
    action = F.when(F.col("group_id").isNull(), "KEEP_UNIQUE").when(master, "KEEP_MASTER").otherwise("ARCHIVE_DUPLICATE")
    return rows.select(
        base_name("path").alias("file_name"), status.alias("status"), action.alias("recommended_action"), "group_id", F.coalesce("group_size", F.lit(1)).alias("group_size"), "confidence",
        F.coalesce("match_type", F.lit("none")).alias("match_type"), size_kb("length").alias("file_size_kb"), F.col("sha256").alias("sha256_hash"), F.col("path").alias("file_path"),
    )


def inventory_order():
    rank = F.when(F.col("status") == "DUPLICATE", 0).when(F.col("status") == "CANONICAL_MASTER", 1).otherwise(2)
    return [rank, F.coalesce("group_id", F.lit(999_999)), F.col("file_name"), F.col("file_path")]


def kept(stock: DataFrame) -> DataFrame:
    """The rows of an inventory that stay."""
    return stock.where(F.col("recommended_action").isin("KEEP_UNIQUE", "KEEP_MASTER"))


def archived(stock: DataFrame) -> DataFrame:
    """The rows of an inventory that go to the archive."""
    return stock.where(F.col("recommended_action") == "ARCHIVE_DUPLICATE")


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """How often each value occurs, the most frequent first; nulls don't count."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def summary(images: DataFrame, members: DataFrame) -> DataFrame:
    """(metric, value) as text: five totals, then a count for each match type."""
    total = images.agg(F.count("*").alias("total"))
    first = F.col("file_path") == F.col("representative")
    counted = members.agg(F.count_if(first).alias("groups"), F.count("*").alias("grouped"), *[F.count_if(first & (F.col("match_type") == t)).alias(t) for t in TYPES])
    row = total.crossJoin(counted)  # one row each
    metrics = {
        "total_images": F.col("total"), "duplicate_groups": F.col("groups"), "images_in_groups": F.col("grouped"), "unique_images": F.col("total") - F.col("grouped"),
        "redundant_images": F.col("grouped") - F.col("groups"), **{f"groups_{t}": F.col(t) for t in reversed(TYPES)},
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("string").alias("value")) for k, v in metrics.items()])
    return row.select(F.explode(pairs).alias("m")).select("m.*")


def kpis(images: DataFrame, members: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: total, grouped, unique, overlap percent, blocked pairs."""
    row = images.agg(F.count("*").alias("total")).crossJoin(members.agg(F.count("*").alias("grouped"))).crossJoin(rejected.agg(F.count("*").alias("blocked")))
    return row.select("total", "grouped", F.greatest(F.lit(0), F.col("total") - F.col("grouped")).alias("unique"), F.round(100.0 * F.col("grouped") / F.greatest(F.col("total"), F.lit(1)), 1).alias("overlap_pct"), "blocked")


def page(report: DataFrame, number: int, size: int = 10, bands: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """A page of the report's groups after filters by confidence band and match type."""
    from tessera.functions.columns import confidence_band

    rows = report.select("group_id", "confidence", "match_type", "group_size").distinct()
    if bands:
        rows = rows.where(confidence_band("confidence").isin(*bands))
    if types:
        rows = rows.where(F.col("match_type").isin(*types))
    return rows.orderBy("group_id").offset(number * size).limit(size)


def rejected_sample(rejected: DataFrame, n: int = 50) -> DataFrame:
    """The first n rejected pairs in their order (stage, path_a, path_b); distances that aren't numbers become null."""
    distance = F.when(F.col("color_distance") < F.lit(float("inf")), F.col("color_distance"))
    return rejected.withColumn("color_distance", distance).orderBy("stage", "path_a", "path_b").limit(n)


def telemetry(counts: dict[str, int | float], rejected: DataFrame) -> DataFrame:
    """One row of counters with the first rejected pairs as an array of structs; to_json gives the file's form."""
    sample = rejected_sample(rejected).agg(F.collect_list(F.struct(*rejected.columns)).alias("rejected_pairs"))
    return sample.select(*[F.lit(v).alias(k) for k, v in counts.items()], "rejected_pairs")
