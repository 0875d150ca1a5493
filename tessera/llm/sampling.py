"""Bounded, seeded samples of labelled training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import materialize

#: Files of a sample, and of what is counted from it, at most.
FILES = 16


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Whether crc32(doc_id as text) mod folds is fold; a null doc_id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, positives: int, negatives: int, seed: int = 3) -> tuple[DataFrame, float]:
    """(y, text) for at most `positives` and `negatives` labelled rows outside the fold, in seeded hash order, and the share of positives among all of them.

    The share counts every labelled row outside the fold; only the sampled rows'
    texts are read into the model.  The ids are the only thing that is broadcast:
    positives + negatives rows at most.  Null labels and ids are left out; a doc_id
    with several labels has the largest, and one with several rows the smallest text,
    so the sample has positives + negatives rows at most.
    """
    rows = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    rows = rows.groupBy("id").agg(F.max("y").alias("y")).where(~held_out("id", folds, fold))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit(seed), "id")
    picked = rows.where("y = 1").orderBy(order, "id").limit(positives).unionByName(rows.where("y = 0").orderBy(order, "id").limit(negatives))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sample = docs.select(F.col("doc_id").alias("id"), text.alias("text")).join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("y", "text")
    return materialize(sample.dropDuplicates(["y", "text"]).repartition(FILES, "text"), "sample", FILES), counts.get(1, 0) / max(1, sum(counts.values()))
