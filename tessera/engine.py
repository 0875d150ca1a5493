"""The batch run over an image folder: digests, hash pairs, neighbours, colour gate, groups, reports."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config, set_logging
from tessera.functions.columns import aspect_gap, content_digest, embedding_confidence
from tessera.functions.embedding import Embedder
from tessera.operators import reports
from tessera.operators.cluster import group_members
from tessera.operators.features import split_resume
from tessera.operators.pairs import canonical_rows, cosine_candidates, exact_groups, ivf_candidates, near_duplicates, ordered_pairs, skip_decided, star_edges, tier_split, upgrade_deferred
from tessera.runtime import materialize, python_workers
from tessera.sources.files import discover, header_status, path_order
from tessera.sources.sinks import write_json_row, write_reports

log = logging.getLogger(__name__)
FEATURES = "path string, width int, height int, trim_width int, trim_height int, p long, d long, crop_p long, crop_d long, palette array<array<double>>, grids binary, embedding array<float>"
#: Files over the pixel bound that a run leaves out by name; a folder with more has to be cleaned first.
MOST_LARGE = 10_000
#: Up to so many images are read by path and not with the whole folder.
MOST_PATHS = 1_000


@dataclass
class Result:
    groups: DataFrame
    report: DataFrame
    inventory: DataFrame
    summary: DataFrame
    telemetry: DataFrame
    rejected: DataFrame
    skipped: DataFrame
    written: list[str] = field(default_factory=list)


def image_features(images: DataFrame, config: Config, embedder: Embedder | None = None, background: Callable | None = None) -> DataFrame:
    """Hashes, trimmed size, palette, grids of cells for the recolour score, and an embedding of each row of Spark's image source.

    background(rgb) -> alpha and the embedder are hooks for models; the embedder is
    loaded once in a worker and gets batches.  Without it the embedding is null and
    no neighbours are looked for.
    """
    python_workers(images.sparkSession)

    def features(rows: list) -> pd.DataFrame:
        from tessera.functions import images as im

        out, pictures = [], []
        for r in rows:
            rgb, alpha = im.spark_pixels(r.height, r.width, r.nChannels, r.data)
            if background is not None and config.use_background_removal:
                alpha = background(rgb)
            x0, y0, x1, y1 = im.trim_border(rgb)
            colours = im.palette(rgb, alpha, config.color_n_clusters, config.random_seed, config.color_space, config.color_min_pixel_count)
            if colours is None:
                colours = im.palette(rgb, None, config.color_n_clusters, config.random_seed, config.color_space, 10)
            out.append([r.path, r.width, r.height, x1 - x0, y1 - y0, *im.four_hashes(rgb), [list(c) for c in colours] if colours else None, im.cell_grids(rgb)])
            pictures.append(rgb)
        vectors = [[float(v) for v in x] for x in embedder.vectors(pictures)] if embedder is not None else [None] * len(out)
        frame = pd.DataFrame([(*r, v) for r, v in zip(out, vectors, strict=True)], columns=[f.strip().split(" ")[0] for f in FEATURES.split(", ")])
        for c in ("crop_p", "crop_d"):
            frame[c] = frame[c].astype("Int64")
        return frame

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        many = embedder.batch if embedder is not None else 16
        for pdf in batches:
            rows = list(pdf.itertuples())
            for at in range(0, len(rows), many):
                yield features(rows[at : at + many])

    return images.mapInPandas(run, FEATURES)


def color_gate(pairs: DataFrame, features: DataFrame, config: Config) -> DataFrame:
    """pairs (a, b, ...) with passed, color_distance, reason; a pair without both images' features is left out."""
    side = lambda s: features.select(F.col("path").alias(s), F.col("palette").alias(f"palette_{s}"), F.col("grids").alias(f"grids_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    @F.pandas_udf("passed boolean, color_distance double, reason string")
    def verdict(pa_: pd.Series, pb: pd.Series, xa: pd.Series, xb: pd.Series) -> pd.DataFrame:
        from tessera.functions import images as im

        out = []
        for p, q, x, y in zip(pa_, pb, xa, xb, strict=True):
            spatial = im.recolour_score(x, y) if config.color_space == "lab" else 0.0
            out.append(im.verify_colour([tuple(c) for c in p] if p is not None else None, [tuple(c) for c in q] if q is not None else None, spatial, config.color_distance_threshold, config.color_space))
        return pd.DataFrame(out, columns=["passed", "color_distance", "reason"])

    gated = both.withColumn("v", verdict("palette_a", "palette_b", "grids_a", "grids_b"))
    return gated.select(*pairs.columns, "v.passed", "v.color_distance", "v.reason")


def _plain(c: str):
    return F.regexp_replace(c, "^file:/+", "/")


def decode(spark: SparkSession, folder: str, too_large: list[str], only: DataFrame | None = None) -> DataFrame:
    """Spark's image source over a folder: path, height, width, nChannels, mode, data of what decodes, of the paths in `only` if given.

    Files named in too_large are pruned from the scan, so they are never decoded; a
    short list of paths is read by itself, a long one is joined.
    """
    reader = spark.read.format("image").option("dropInvalid", True)
    few = [r["path"] for r in only.select("path").limit(MOST_PATHS + 1).collect()] if only is not None else None
    if few is not None and 0 < len(few) <= MOST_PATHS:
        images = reader.load([("file://" + p) if "://" not in p else p for p in few])
    else:
        images = reader.option("recursiveFileLookup", True).load(folder)
        if too_large:
            images = images.where(~F.col("_metadata.file_name").isin(too_large))
    images = images.select("image.*").withColumnRenamed("origin", "path").withColumn("path", _plain("path"))
    return images.join(only.select("path"), "path", "left_semi") if only is not None else images


def cached_features(spark: SparkSession, cache: str, images: DataFrame, compute: Callable[[DataFrame], DataFrame], resume: bool) -> tuple[DataFrame, int]:
    """(features of images (path, exact_hash), how many came from the cache folder): with resume, rows with the path and digest of a cached one aren't computed; new rows are added to the folder."""
    path = f"{cache.rstrip('/')}/features"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    keyed = images.select(F.col("path").alias("file_path"), F.col("exact_hash").alias("content_hash"))
    if resume and there:
        held = spark.read.parquet(path).dropDuplicates(["file_path", "content_hash"])
        have, missing = split_resume(keyed, held)
        old = materialize(held.join(have, ["file_path", "content_hash"], "left_semi"), "cached")
    else:
        old, missing = None, keyed
    wanted = missing.select(F.col("file_path").alias("path"))
    fresh = compute(wanted).join(missing, F.col("path") == F.col("file_path")).withColumn("processed_at", F.current_timestamp())
    fresh = materialize(fresh, "features")
    fresh.write.mode("append" if resume else "overwrite").parquet(path)
    columns = [f.strip().split(" ")[0] for f in FEATURES.split(", ")]
    return (fresh if old is None else old.unionByName(fresh)).select(*columns), 0 if old is None else old.count()


def run(
    spark: SparkSession, folder: str, config: Config, embedder: Embedder | None = None, background: Callable | None = None, progress: Callable[[str, float], None] | None = None, strict_bits: int = 2,
    output: str | None = None, sample: int | None = None, cache: str | None = None, resume: bool = False,
) -> Result:
    """The whole batch: cheap stages first, and only the canonical file of each exact class after stage 1.

    sample keeps the first valid images in path order.  With a cache folder the
    features of a run are kept, and with resume those of unchanged files aren't
    computed again.  With an output base path the reports and the telemetry are
    written there.  Files that don't decode or have too many pixels are skipped,
    counted and listed with a status; headers are read before anything is decoded.
    """
    began = time.time()
    set_logging(config)

    def tell(message: str, share: float) -> None:
        log.info("%s (%d %%)", message, round(100 * share))
        if progress is not None:
            progress(message, share)

    tell("headers and digests", 0.1)
    files = discover(spark, folder, config.supported_extensions)
    known = header_status(files, config.max_image_pixels).select(
        _plain("path").alias("path"), "length", "width", "height", "status", content_digest("content", config.hash_algorithm).alias("exact_hash"), F.sha2("content", 256).alias("sha256")
    )
    known = materialize(known, "files")
    large = [r["name"] for r in known.where("status = 'too large'").select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name")).distinct().limit(MOST_LARGE + 1).collect()]
    if len(large) > MOST_LARGE:
        raise ValueError(f"more than {MOST_LARGE} files have over {config.max_image_pixels} pixels")
    readable = known.where("status = 'valid'").select("path", "length", "exact_hash", "sha256")
    if sample is not None:
        readable = readable.orderBy(path_order()).limit(sample)
    readable = materialize(readable, "readable")
    tell("hashes", 0.3)
    # files of equal content decode alike, so pixels are read once for each class
    firsts = materialize(canonical_rows(readable).select("path", "exact_hash"), "firsts")
    compute = lambda paths: image_features(decode(spark, folder, large, paths), config, embedder, background)
    cached = 0
    if cache is not None:
        features, cached = cached_features(spark, cache, firsts, compute, resume)
    else:
        features = materialize(compute(firsts.select("path")), "features")
    decodes = firsts.join(features.select("path"), "path", "left_semi").select("exact_hash")
    images = materialize(readable.join(decodes, "exact_hash", "left_semi").select("path", "length", "exact_hash", "sha256"), "images")
    skipped = known.where("status <> 'valid'").select("path", "status").unionByName(readable.join(decodes, "exact_hash", "left_anti").select("path", F.lit("invalid").alias("status")))
    if images.isEmpty():
        log.warning("no valid images in %s", folder)
    exact = star_edges(images)
    hashes = near_duplicates(features.select(F.col("path").alias("id"), "p", "d", "crop_p", "crop_d"), config.phash_threshold, config.dhash_threshold, config.confidence_phash_base, config.confidence_phash_decay)
    tiers = materialize(tier_split(hashes, strict_bits), "tiers")
    sides = lambda s: features.select(F.col("path").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("width", "height", "trim_width", "trim_height")])
    gap = F.greatest(aspect_gap("width_a", "height_a", "width_b", "height_b"), aspect_gap("trim_width_a", "trim_height_a", "trim_width_b", "trim_height_b"))
    strict = tiers.where("tier = 'strict'").join(sides("a"), "a").join(sides("b"), "b").where(gap <= 0.15).select(*tiers.columns)
    hash_gate = materialize(color_gate(strict, features, config), "gate")
    matched = hash_gate.where("passed").select("a", "b", "confidence", "match_type")
    tell("neighbours", 0.6)
    refused = hash_gate.where("not passed").select("a", "b", F.lit("hash").alias("stage"), F.lit(None).cast("double").alias("similarity"), "color_distance", "reason")
    edges = exact.unionByName(matched)
    vectors = features.where("embedding is not null").select(F.col("path").alias("id"), "embedding")
    candidates_n = passed_n = again_n = 0
    rejected = refused
    if vectors.limit(2).count() == 2:
        exact_search = vectors.count() < config.faiss_brute_force_threshold
        near = cosine_candidates(vectors, config.similarity_k, config.similarity_threshold) if exact_search else ivf_candidates(vectors, config.similarity_k, config.similarity_threshold, config.faiss_nlist, config.faiss_nprobe, config.random_seed)
        near = materialize(ordered_pairs(near), "near")
        open_ = materialize(skip_decided(near, matched, refused), "open")
        gated = materialize(color_gate(open_.where("not was_rejected").drop("was_rejected"), features, config), "gate")
        accepted = gated.where("passed").withColumn("confidence", embedding_confidence("similarity", "color_distance", config.confidence_embedding_base, config.color_distance_threshold))
        edges = edges.unionByName(upgrade_deferred(accepted.select("a", "b", "confidence"), tiers.where("tier = 'deferred'")))
        more = gated.where("not passed").select("a", "b", F.lit("embedding").alias("stage"), F.round("similarity", 4).alias("similarity"), "color_distance", "reason")
        # pairs that the hash stage rejected get the similarity that they turn out to have
        again = open_.where("was_rejected").select("a", "b", F.round("similarity", 4).alias("found"))
        filled = refused.join(again, ["a", "b"], "left").withColumn("similarity", F.coalesce("similarity", "found")).drop("found")
        rejected = filled.unionByName(more)
        candidates_n, passed_n, again_n = near.count(), accepted.count(), open_.where("was_rejected").count() + more.count()
    tell("groups", 0.8)
    rejected = rejected.select("stage", F.col("a").alias("path_a"), F.col("b").alias("path_b"), "similarity", "color_distance", F.lit(config.color_distance_threshold).alias("threshold"), "reason")
    distances = tiers.select(F.col("a").alias("path_a"), F.col("b").alias("path_b"), "p_dist")
    rejected = rejected.join(distances, ["path_a", "path_b"], "left").withColumnRenamed("p_dist", "phash_distance")
    rejected = materialize(rejected.select("stage", "path_a", "path_b", "similarity", "phash_distance", "color_distance", "threshold", "reason"), "rejected")
    members = materialize(group_members(edges, rejected.select(F.col("path_a").alias("a"), F.col("path_b").alias("b"))), "groups")
    groups = members.groupBy("group_id", "confidence", "match_type").agg(F.array_sort(F.collect_list("file_path")).alias("members"))
    report = materialize(reports.group_report(members).orderBy("group_id", "file_path"), "report")
    stock = materialize(reports.inventory(images, members).orderBy(*reports.inventory_order()), "inventory")
    summary = reports.summary(images, members)
    exact_n = exact_groups(images).agg(F.count("*").alias("n"), F.coalesce(F.sum("group_size"), F.lit(0)).alias("m")).first()
    counts = {
        "total_images": images.count(), "groups_found": members.where("file_path = representative").count(), "images_in_groups": report.count(), "runtime_seconds": round(time.time() - began, 2), "stage1_exact_groups": exact_n["n"],
        "stage1_exact_images": exact_n["m"], "stage2_phash_candidates": tiers.count(), "stage2_matched": matched.count(), "stage3_clip_candidates": candidates_n, "stage4_passed": passed_n, "stage4_rejected": again_n,
        "skipped_images": skipped.count(), "cached_images": cached,
    }
    telemetry = reports.telemetry(counts, rejected)
    written = []
    if output is not None:
        written = [*write_reports(report, summary, stock, output), write_json_row(telemetry, f"{output}_telemetry.json")]
    tell("done", 1.0)
    return Result(groups, report, stock, summary, telemetry, rejected, skipped, written)
