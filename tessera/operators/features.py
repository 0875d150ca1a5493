"""The feature table: resume, upsert and partial update keyed by (file_path, content_hash)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["file_path", "content_hash"]


def split_resume(images: DataFrame, features: DataFrame, resume: bool = True) -> tuple[DataFrame, DataFrame]:
    """(cached, missing) rows of images; without resume all are missing."""
    if not resume:
        return images.limit(0), images
    keys = features.select(*KEY).distinct()
    return images.join(keys, KEY, "left_semi"), images.join(keys, KEY, "left_anti")


def upsert(features: DataFrame, fresh: DataFrame, at: str = "processed_at") -> DataFrame:
    """The latest non-null value of each column by key, so a partial update keeps what it doesn't carry."""
    names = [c for c in features.columns if c not in (*KEY, at)]
    both = features.unionByName(fresh, allowMissingColumns=True)
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in names]
    return both.groupBy(*KEY).agg(*latest, F.max(at).alias(at)).select(*features.columns)


def with_embedding(features: DataFrame) -> DataFrame:
    return features.where("embedding is not null")


def count_features(features: DataFrame) -> DataFrame:
    """One row: files in the feature table, and those with an embedding."""
    keys = features.groupBy(*KEY).agg(F.max(F.col("embedding").isNotNull()).alias("e"))
    return keys.agg(F.count("*").alias("files"), F.count_if("e").alias("embedded"))


PALETTE = "array<array<double>>"


def encode_palette(column: str):
    """A palette as the JSON text that a feature table holds."""
    return F.to_json(F.col(column))


def decode_palette(column: str):
    """The palette in a JSON text; null where it is none."""
    return F.from_json(F.col(column), PALETTE)
