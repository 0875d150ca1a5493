"""Session helpers: the shared folder for intermediate tables, table access, and what Python workers need."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where it may be unset, one made here."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _fallback:
        _fallback[key] = "file://" + os.path.join(tempfile.gettempdir(), f"tessera-{uuid.uuid4().hex}")
    return _fallback[key]


def materialize(df: DataFrame, name: str = "table", files: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there and lost executors lose nothing.

    `files` bounds the files of a table that stays small however large the input
    is; without it there is one for each partition of the session's shuffles, and
    without Hadoop's native library an executor spawns processes for each file.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = hadoop.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of few rows and about `most` bytes (one row at least), so that what a worker makes of a part fits, however long texts are."""
    for batch in batches:
        each = max(1, batch.nbytes // max(1, len(batch)))
        step = max(1, min(rows, most // each))
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)


def python_workers(spark: SparkSession) -> None:
    """Make this package importable in Python workers."""
    key = spark.sparkContext.applicationId
    if key not in _shipped:
        root = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(), "tessera_package.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        spark.sparkContext.addPyFile(archive)
        _shipped.add(key)
