"""Evaluation against truth: pairwise sets, confusion counts, purity, accuracy by kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def member_pairs(groups: DataFrame, group: str = "group_id", member: str = "file_name") -> DataFrame:
    a, b = groups.select(group, F.col(member).alias("a")), groups.select(group, F.col(member).alias("b"))
    return a.join(b, group).where("a < b").select("a", "b").distinct()


def pairwise_scores(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, fn and percentages of pair sets (a, b): precision 100, recall 0 and f1 0 on empty denominators."""
    tp = predicted.intersect(truth).agg(F.count("*").alias("tp"))
    fp = predicted.subtract(truth).agg(F.count("*").alias("fp"))
    fn = truth.subtract(predicted).agg(F.count("*").alias("fn"))
    row = tp.crossJoin(fp).crossJoin(fn)
    p = F.when(F.col("tp") + F.col("fp") > 0, 100.0 * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(100.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, 100.0 * F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    row = row.withColumn("p", p).withColumn("r", r)
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return row.select("tp", "fp", "fn", F.round("p", 2).alias("precision"), F.round("r", 2).alias("recall"), F.round(f1, 2).alias("f1"))


def judged_pairs(truth: DataFrame, assigned: DataFrame) -> DataFrame:
    """truth (image_a, image_b, is_duplicate, category) with whether assigned (file_name, group_id) puts both into one group."""
    a, b = assigned.select(F.col("file_name").alias("image_a"), F.col("group_id").alias("ga")), assigned.select(F.col("file_name").alias("image_b"), F.col("group_id").alias("gb"))
    return truth.join(a, "image_a", "left").join(b, "image_b", "left").withColumn("same", F.coalesce(F.col("ga") == F.col("gb"), F.lit(False)))


def confusion(judged: DataFrame) -> DataFrame:
    """Counts and scores by category and over all (category null): precision and recall 1, f1 0 on empty denominators."""
    d, s = F.col("is_duplicate"), F.col("same")
    rows = judged.rollup("category").agg(F.grouping("category").alias("overall"), F.count_if(d & s).alias("tp"), F.count_if(~d & s).alias("fp"), F.count_if(d & ~s).alias("fn"), F.count_if(~d & ~s).alias("tn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(1.0)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return rows.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1)


def color_fp_rate(judged: DataFrame, category: str = "same_product_different_color") -> DataFrame:
    here = F.col("category") == category
    n, bad = F.count_if(here), F.count_if(here & F.col("same"))
    return judged.agg(n.alias("n"), bad.alias("false_positives"), F.when(n > 0, bad / n).otherwise(0.0).alias("rate"))


def kind_accuracy(cases: DataFrame) -> DataFrame:
    """By kind: cases, correct ones (expect_grouped equals grouped_together) and percent."""
    right = F.count_if(F.col("expect_grouped") == F.col("grouped_together"))
    return cases.groupBy("kind").agg(F.count("*").alias("cases"), right.alias("correct"), F.round(100.0 * right / F.count("*"), 1).alias("accuracy"))


def purity(members: DataFrame) -> DataFrame:
    """Of members (group_id, label): pairs of one label, of two, the share of the first, and groups of several labels; counted without making the pairs."""
    per = members.groupBy("group_id", "label").agg(F.count("*").alias("n"))
    groups = per.groupBy("group_id").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.count("*").alias("labels"))
    same, every = F.sum((F.col("sq") - F.col("n")) / 2), F.sum(F.col("n") * (F.col("n") - 1) / 2)
    rows = groups.agg(F.coalesce(same, F.lit(0.0)).cast("long").alias("same"), F.coalesce(every - same, F.lit(0.0)).cast("long").alias("different"), F.count_if(F.col("labels") > 1).alias("mixed_groups"))
    whole = F.col("same") + F.col("different")
    return rows.select("same", "different", "mixed_groups", F.when(whole > 0, F.round(100.0 * F.col("same") / whole, 2)).otherwise(100.0).alias("purity_pct"))


def violations(groups: DataFrame, controls: DataFrame) -> DataFrame:
    """Negative-control files that are in any group."""
    return groups.join(controls.select(F.col("variant_file").alias("file_name")), "file_name", "left_semi").select("file_name").distinct()
