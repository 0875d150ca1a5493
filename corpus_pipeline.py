"""The corpus pipeline: quality rules, near-dedup, benchmark decontamination, source mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontaminate import decontaminate
from tessera.llm.mixing import mix_documents
from tessera.llm.neardup import drop_near_duplicates
from tessera.llm.quality_rules import keep_quality
from tessera.llm.sharding import shard_documents
from tessera.runtime import discard, materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and short texts, repetitive ones, and those far from their language. Repeated rows are judged alike."""
    return keep_quality(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that with the smallest doc_id; of rows that repeat it and its text one stays. Rows without a doc_id or without words link with nothing and stay.

    Sets are shingles of five words, as for prose in general, and not of two as in
    the query op1: two documents that share many word pairs need not be copies.
    """
    return drop_near_duplicates(docs, width=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with test items beyond the coverage limit go; others, null and empty texts among them, stay as they are."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is given as often as the mix takes its words: whole copies, and one more by a seeded draw. Texts without words stay once; a null source is a source of its own."""
    return mix_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, group_id and links of each row, repeated rows, null texts and null doc_ids included."""
    return shard_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Shingle minima, seeded draws and label propagation have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's table goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            after = materialize(after, name)
            if i:
                discard(docs)
        docs = after
    return docs
