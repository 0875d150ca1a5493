"""Positions of rows in a global order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import materialize


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with position: 0, 1, ... in the given order, from a range partitioning and one offset for each partition."""
    spark = rows.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    laid = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    laid = materialize(laid, "positions").withColumn("__part", F.shiftright("__id", 33))
    counts = sorted((r["__part"], r["n"]) for r in laid.groupBy("__part").agg(F.count("*").alias("n")).collect())
    starts = [(part, sum(n for q, n in counts if q < part)) for part, _ in counts]
    offsets = F.broadcast(spark.createDataFrame(starts, "__part long, __start long"))  # one row for each partition
    joined = laid.join(offsets, "__part").withColumn("position", F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    return joined.drop("__part", "__start", "__id")


def numbered_groups(groups: DataFrame) -> DataFrame:
    """groups (confidence, group_size, representative, ...) with group_id: 1, 2, ... by confidence and size, both falling, then representative."""
    keyed = groups.withColumn("__c", -F.col("confidence")).withColumn("__s", -F.col("group_size"))
    return positions(keyed, ["__c", "__s", "representative"]).withColumn("group_id", F.col("position") + 1).drop("__c", "__s", "position")
