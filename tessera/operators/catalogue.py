"""Catalogue building: distinct seeds, capped classes, counters, positions and name or size filters."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.columns import model_stem
from tessera.operators.ordering import positions
from tessera.operators.pairs import hamming_join
from tessera.runtime import discard, materialize, python_workers


#: Undecided seeds, and close pairs of their signatures, that one task scans.
SEEDS, PAIRS = 1 << 18, 1 << 21


def _scan(rows: pa.Table, close: pa.Table) -> pa.Table:
    """The paths of rows (path, stem, sig) that the scan accepts, with the close signatures (a, b)."""
    order = pc.sort_indices(rows, sort_keys=[("path", "ascending"), ("sig", "ascending")]).to_pylist()
    names, sig = np.unique(rows.column("sig").to_numpy(), return_inverse=True)
    stems = pa.concat_arrays(rows.column("stem").chunks).dictionary_encode().indices.to_pylist()
    ends = [np.searchsorted(names, close.column(c).to_numpy()) for c in ("a", "b")]
    one, other = np.concatenate(ends), np.concatenate(ends[::-1])
    by = np.argsort(one, kind="stable")
    first, other = np.searchsorted(one[by], np.arange(len(names) + 1)).tolist(), other[by]
    used, excluded, kept = set(), np.zeros(len(names), bool), []
    sigs = sig.tolist()
    for r in order:
        s = sigs[r]
        if excluded[s] or stems[r] in used:
            continue
        kept.append(r)
        used.add(stems[r])
        excluded[s] = True
        excluded[other[first[s] : first[s + 1]]] = True
    return rows.select(["path"]).take(pa.array(kept, pa.int64()))


def _counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    seen = Observation()
    table = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return table, seen.get.get("n") or 0


def distinct_seeds(seeds: DataFrame, p_max: int = 8, d_max: int = 6, n: int | None = None, scanned: tuple[int, int] = (SEEDS, PAIRS)) -> DataFrame:
    """The paths of seeds (path, stem, p, d) that a scan in path order accepts: a seed goes if an accepted one has its cleaned stem or is within both Hamming distances.

    The scan's result is the lexicographically first independent set.  While more than
    `scanned` seeds are undecided, or pairs of their signatures close, it is found in
    rounds: the undecided seeds that are first of their stem and first among their
    signature and its neighbours are accepted at once, and what they exclude goes,
    pairs included; the first undecided seed is always accepted.  What is left then,
    which depends on no other seed, is scanned in one task, however long its chains.
    Equal signatures and equal stems are classes with one minimum each, so a
    large class costs its rows and no pairs.  Null signatures have no neighbours,
    null stems equal none.
    With n, the first n that are accepted.
    """
    python_workers(seeds.sparkSession)
    alone = F.concat(F.lit("?"), F.col("path"))
    rows = materialize(seeds.select("path", F.coalesce(model_stem("stem"), alone).alias("stem"), "p", "d").withColumn("i", F.monotonically_increasing_id()), "seeds")
    signed = F.col("p").isNotNull() & F.col("d").isNotNull()
    classes = rows.where(signed).groupBy("p", "d").agg(F.min("i").alias("id"))
    close, pairs = _counted(hamming_join(classes, p_max, d_max).select("a", "b"), "close")
    placed = rows.where(signed).join(classes, ["p", "d"]).select("path", "stem", F.col("id").alias("sig"))
    open_, left = _counted(placed.unionByName(rows.where(~signed).select("path", "stem", F.col("i").alias("sig"))), "open")
    accepted: list[DataFrame] = []
    while left > scanned[0] or pairs > scanned[1]:
        near = close.unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = open_.groupBy("sig").agg(F.min("path").alias("low"))
        around = near.join(low, F.col("b") == F.col("sig")).select("a", "low").unionByName(low.select(F.col("sig").alias("a"), "low")).groupBy("a").agg(F.min("low").alias("first_near"))
        by_stem = open_.groupBy("stem").agg(F.min("path").alias("first_stem"))
        won = open_.join(by_stem, "stem").where("path = first_stem").join(around, F.col("sig") == F.col("a")).where("path = first_near").select("path", "stem", "sig")
        won = materialize(won, "won")
        accepted.append(won)
        sigs = won.select("sig").distinct()
        gone = near.join(sigs.withColumnRenamed("sig", "b"), "b").select(F.col("a").alias("sig")).unionByName(sigs).distinct()
        open_, left = _counted(open_.join(won.select("stem").distinct(), "stem", "left_anti").join(gone, "sig", "left_anti").select("path", "stem", "sig"), "open")
        before, still = close, open_.select("sig").distinct()
        close, pairs = _counted(close.join(still.withColumnRenamed("sig", "a"), "a", "left_semi").join(still.withColumnRenamed("sig", "b"), "b", "left_semi").select("a", "b"), "close")
        discard(before)
    if left or not accepted:
        together = open_.groupBy(F.lit(0).alias("k")).cogroup(close.groupBy(F.lit(0).alias("k")))
        accepted.append(together.applyInArrow(_scan, f"path {dict(open_.dtypes)['path']}"))
    out = reduce(DataFrame.unionByName, [a.select("path") for a in accepted])
    return out.orderBy("path").limit(n) if n is not None else out


def models(rows: DataFrame, name: str = "file_name") -> DataFrame:
    """(model_id, primary_file, all_views) of files by their cleaned stem, views in name order; a model's views fit a row."""
    stem = model_stem(F.regexp_replace(name, r"\.[^.]*$", ""))
    return rows.groupBy(stem.alias("model_id")).agg(F.min(name).alias("primary_file"), F.array_sort(F.collect_list(name)).alias("all_views"))


def capped_classes(rows: DataFrame, name: str, rules: list[tuple[str, list[str], list[str]]], cap: int, default: str) -> DataFrame:
    """rows with class: the first rule (class, firm keywords, soft keywords) that takes the name, in name order.

    Firm keywords always take; soft ones only while the class holds fewer than cap
    rows.  Until then every hit is taken, so a soft hit is taken if it is among the
    first cap hits: one top-k for each rule gives that bound, and no row is ranked.
    """
    low = F.lower(F.col(name))
    has = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words], F.lit(False))
    out = rows.withColumn("class", F.lit(None).cast("string"))
    for label, firm, soft in rules:
        free = F.col("class").isNull()
        takes = has(firm)
        if soft:
            last = out.where(free & (has(firm) | has(soft))).select(name).orderBy(name).limit(cap).agg(F.max(name)).first()[0]
            takes = takes | (has(soft) & (F.col(name) <= F.lit(last))) if last is not None else takes
        out = out.withColumn("class", F.when(free & takes, label).otherwise(F.col("class")))
    return out.withColumn("class", F.coalesce("class", F.lit(default)))


def running_counter(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with counter: 1, 2, ... within each key."""
    return rows.withColumn("counter", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def round_robin(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """rows with position and turn: the position modulo n."""
    return positions(rows, order).withColumn("turn", F.pmod("position", F.lit(n)).cast("int"))


def seeded_order(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """rows in an order that depends on the seed and the key alone; limit gives a repeatable sample."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key)


def without_marks(rows: DataFrame, name: str, marks: tuple[str, ...] = ("COPY", "CROP", "RESIZED", "VARIANT")) -> DataFrame:
    """Rows whose name carries none of the marks of generated files."""
    return rows.where(~F.col(name).rlike("|".join(marks)))


def without_sizes(images: DataFrame, sizes: list[tuple[int, int]], categories: list[str] | None = None) -> DataFrame:
    """Images (width, height, ...) of no banner size and, if given, of the listed categories."""
    banner = reduce(lambda a, b: a | b, [(F.col("width") == w) & (F.col("height") == h) for w, h in sizes], F.lit(False))
    kept = images.where(~banner)
    return kept.where(F.col("category").isin(*categories)) if categories is not None else kept


def smallest_class(rows: DataFrame, label: str, classes: list[str]) -> str:
    """The class with the fewest rows, absent classes included; the earlier of equals."""
    n = {r[label]: r["n"] for r in rows.where(F.col(label).isin(*classes)).groupBy(label).agg(F.count("*").alias("n")).collect()}
    return min(classes, key=lambda c: n.get(c, 0))


def cluster_stats(members: DataFrame, key: str) -> DataFrame:
    """Counts of true clusters (two members at least) and of unique members."""
    sizes = members.groupBy(key).agg(F.count("*").alias("n"))
    return sizes.agg(F.count_if(F.col("n") >= 2).alias("clusters"), F.coalesce(F.sum(F.when(F.col("n") >= 2, F.col("n"))), F.lit(0)).alias("clustered"), F.count_if(F.col("n") == 1).alias("unique"))
