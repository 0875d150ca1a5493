"""Registered queries of the operators in this subpackage, each over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.oracles import ORACLES  # noqa: F401
from tessera.runtime import table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.neardup import minhash_components

    return minhash_components(table(spark, sf_dir, "documents"), width=2, percent=80)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import benchmark_digest

    return benchmark_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op3_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op2_clause_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_model import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_dedup import line_digest

    return line_digest(table(spark, sf_dir, "documents"))


def op7_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import extract_pii

    return extract_pii(table(spark, sf_dir, "documents"))


def op8_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_clause_toxicity, op3_label_propagation_shards, op4_line_dedup, op5_quality_classifier,
        op6_benchmark_decontamination, op7_contextual_pii, op8_secret_ownership, op9_quality_rules, op10_mix_sources,
    )
}
