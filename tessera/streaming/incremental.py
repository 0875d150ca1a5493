"""Incremental runs: new files' digests upserted batch by batch, and streaming exact dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.features import KEY


def dedup_stream(rows: DataFrame, key: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """Rows of a stream without later ones of an equal key inside the watermark; state is dropped as the watermark passes."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def digest_stream(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("file_path"), F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("processed_at"))


def feature_sink(table_path: str):
    """For foreachBatch: appends rows whose key the feature table doesn't have; a batch that is run again adds nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(KEY)
        path = spark._jvm.org.apache.hadoop.fs.Path(table_path)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(spark.read.parquet(table_path).select(*KEY), KEY, "left_anti")
        fresh.write.mode("append").parquet(table_path)

    return write
