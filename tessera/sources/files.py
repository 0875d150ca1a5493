"""Sources: image folders, archives, truth and report files, manifests."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import base_name, suffix, truth_flag
from tessera.runtime import python_workers

REPORT = "group_id int, file_path string, file_name string, confidence int, match_type string, group_size int"
INVENTORY = "file_name string, status string, recommended_action string, group_id int, group_size int, confidence int, match_type string, file_size_kb double, sha256_hash string, file_path string"
TRUTH = "image_a string, image_b string, is_duplicate string, category string"
CLUSTERS = "target_count int, actual_count int, true_duplicate_clusters map<string,array<string>>, negative_controls array<struct<variant_file:string,original_product:string,category:string,color:string>>, unique_files array<string>"
MANIFEST = "model_id:string,primary_file:string,all_views:array<string>"


def discover(spark: SparkSession, folder: str, extensions: tuple[str, ...], recursive: bool = True) -> DataFrame:
    """path, modificationTime, length, content of files with a supported suffix in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.where(suffix("path").isin(*extensions))


def path_order():
    """Order by path components."""
    return F.split("path", "/")


def image_sizes(files: DataFrame) -> DataFrame:
    """files with width and height read from the header of PNG, JPEG, GIF, BMP, WebP or TIFF content; null where it is none."""
    from tessera.functions.images import header_size

    python_workers(files.sparkSession)

    @F.pandas_udf("width int, height int")
    def sizes(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([header_size(bytes(c) if c is not None else b"") or (None, None) for c in content], columns=["width", "height"]).astype("Int32")

    return files.withColumn("__size", sizes("content")).select("*", "__size.width", "__size.height").drop("__size")


def header_status(files: DataFrame, max_pixels: int) -> DataFrame:
    """files with width, height and status from the header alone: `valid`, `too large` for more than max_pixels, or `invalid`."""
    sized = image_sizes(files)
    pixels = F.col("width").cast("long") * F.col("height")
    return sized.withColumn("status", F.when(pixels.isNull() | (pixels <= 0), "invalid").when(pixels > max_pixels, "too large").otherwise("valid"))


def valid_images(files: DataFrame, max_pixels: int, sample: int | None = None) -> DataFrame:
    """Files whose header reads and whose pixels are within the bound; the first `sample` of them in path order."""
    good = header_status(files, max_pixels).where("status = 'valid'").drop("status")
    return good.orderBy(path_order()).limit(sample) if sample is not None else good


def demo_images(spark: SparkSession, folder: str, extensions: tuple[str, ...], n: int | None = None) -> DataFrame:
    """path and file_name of the images of a bundled folder in path order, without their contents; a missing folder has none."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], "path string, file_name string")
    rows = discover(spark, folder, extensions).select("path", base_name("path").alias("file_name")).orderBy(path_order())
    return rows.limit(n) if n is not None else rows


def count_images(files: DataFrame, extensions: tuple[str, ...]) -> int:
    return files.where(suffix("path").isin(*extensions)).count()


def unzip(archives: DataFrame, extensions: tuple[str, ...], max_bytes: int = 1 << 30) -> DataFrame:
    """(archive, path, content) of the image members of archives (path, content); absolute paths, parent steps and other files are left out."""
    python_workers(archives.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for info in archive.infolist():
                            name = PurePosixPath(info.filename.replace("\\", "/"))
                            safe = not info.is_dir() and not name.is_absolute() and ".." not in name.parts
                            if safe and name.suffix.lower() in extensions and info.file_size <= max_bytes:
                                yield pd.DataFrame({"archive": [path], "path": [str(name)], "content": [archive.read(info)]})
                except zipfile.BadZipFile:
                    continue

    return archives.select("path", "content").mapInPandas(run, "archive string, path string, content binary")


def stage_names(names: DataFrame) -> DataFrame:
    """names (seq, name) with a staged name: the second and later ones of a name get their count in front."""
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("name").orderBy("seq"))
    return names.withColumn("staged", F.when(n == 1, F.col("name").cast("string")).otherwise(F.concat_ws("_", (n - 1).cast("string"), "name")))


def stage_files(uploads: DataFrame, folder: str) -> DataFrame:
    """Copies of uploads (seq, name, content) under folder by their staged names: name, staged, target."""
    from tessera.sources.sinks import copy_files

    staged = stage_names(uploads).withColumn("target", F.concat_ws("/", F.lit(folder.rstrip("/")), "staged"))
    return copy_files(staged.select("name", "staged", "target", "content"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of schema that a CSV file has, with or without a byte order mark; a missing file has no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.lstrip("\ufeff").strip() for c in rows.columns])
    kinds = dict(part.strip().split(" ") for part in schema.split(","))
    return rows.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in kinds.items() if c in rows.columns])


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A group report CSV with or without a byte order mark; a missing file is an empty report."""
    return _read_csv(spark, path, REPORT)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """An inventory CSV with or without a byte order mark; a missing file is an empty inventory."""
    return _read_csv(spark, path, INVENTORY)


def read_workbook(spark: SparkSession, path: str, schema: str = REPORT, sheet: str | None = None) -> DataFrame:
    """A sheet of an .xlsx file, the first unless it is named: a header row, then cells of numbers, inline or shared strings.

    Workbooks have about a million rows at most; the file is parsed in one worker,
    event by event.
    """
    python_workers(spark)
    kinds = dict(part.strip().split(" ") for part in schema.split(","))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows: list[dict[str, str]] = []
                for row in sheet_rows(bytes(content), sheet):
                    rows.append({c: row.get(c) for c in kinds})
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=list(kinds), dtype=object)
                        rows = []
                yield pd.DataFrame(rows, columns=list(kinds), dtype=object)

    text = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"{c} string" for c in kinds))
    return text.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[dict[str, str]]:
    """Rows of a sheet by header name."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        found = [s for s in book.iter(f"{main}sheet") if sheet is None or s.get("name") == sheet]
        if not found:
            raise ValueError(f"no sheet {sheet!r}")
        parts = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        shared: list[str] = []
        if "xl/sharedStrings.xml" in archive.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{main}t")) for item in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).iter(f"{main}si")]
        names: dict[str, str] | None = None
        with archive.open("xl/" + parts[found[0].get(link)].lstrip("/").removeprefix("xl/")) as file:
            for _, row in ElementTree.iterparse(file):
                if row.tag != f"{main}row":
                    continue
                cells = {}
                for cell in row.iter(f"{main}c"):
                    value = cell.find(f"{main}v")
                    text = "".join(t.text or "" for t in cell.iter(f"{main}t")) if cell.get("t") == "inlineStr" else value.text if value is not None else None
                    if cell.get("t") == "s" and text is not None:
                        text = shared[int(text)]
                    if text is not None:
                        cells[(cell.get("r") or "").rstrip("0123456789")] = text
                row.clear()
                if names is None:
                    names = cells
                else:
                    yield {names[at]: text for at, text in cells.items() if at in names}


def read_truth_pairs(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    rows = rows.toDF(*[c.lstrip("\ufeff").strip() for c in rows.columns])
    return rows.select(F.trim("image_a").alias("image_a"), F.trim("image_b").alias("image_b"), truth_flag("is_duplicate").alias("is_duplicate"), F.trim("category").alias("category"))


def read_truth_clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLUSTERS).option("multiLine", True).json(path)


def cluster_members(truth: DataFrame) -> DataFrame:
    rows = truth.select(F.explode("true_duplicate_clusters").alias("group_id", "members"))
    return rows.where(F.size("members") >= 2).select("group_id", F.explode("members").alias("file_name"))


def read_manifest(spark: SparkSession, path: str, domain: str | None = None, folder: str | None = None, merged: tuple[str, ...] = ("merged", "all_merged")) -> DataFrame:
    """Models of a domain manifest in its order: domain, seq, model_id, primary_file, all_views.

    The domain is the exact key, else the first key in the file that contains the
    name or is contained in it, in any case; a ValueError lists the keys if there is
    none.  All domains are read without a name or for one of `merged`.  With a folder
    only models whose primary file it has are given.
    """
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.map_entries(F.from_json("value", f"map<string,array<struct<{MANIFEST}>>>"))).alias("at", "entry"))
    rows = rows.select("at", F.col("entry.key").alias("domain"), F.col("entry.value").alias("models"))
    if domain and domain not in merged:
        keys = text.select(F.json_object_keys("value")).first()[0] or []  # the domains of one file
        low = domain.lower()
        key = domain if domain in keys else next((k for k in keys if low in k.lower() or k.lower() in low), None)
        if key is None:
            raise ValueError(f"no domain like {domain!r}; there are {keys}")
        rows = rows.where(F.col("domain") == key)
    models = rows.select("at", "domain", F.posexplode("models").alias("seq", "m")).orderBy("at", "seq").select("domain", "seq", "m.*")
    if folder is not None:
        files = spark.read.format("binaryFile").load(folder).select(base_name("path").alias("primary_file")).distinct()
        models = models.join(files, "primary_file", "left_semi").select(*models.columns).orderBy("domain", "seq")
    return models


def read_seeds(spark: SparkSession, path: str, present: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """File names of a JSON list, in its order; those present only, the first n."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", "array<string>")).alias("seq", "file_name"))
    rows = rows.where(~F.upper("file_name").rlike("COPY|CROP|RESIZED|VARIANT"))
    if present is not None:
        rows = rows.join(present.select("file_name"), "file_name", "left_semi")
    return rows.orderBy("seq").limit(n) if n else rows

