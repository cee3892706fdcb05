"""Which files changed since they were read: a table of path, size and mtime."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .transcripts import file_path

MTIME_TOLERANCE = 1e-6


def listing(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """path (as ``transcripts.scan`` has it), size and mtime (seconds) of the files below ``root``; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select(file_path().alias("path"), F.col("length").alias("size"), F.unix_micros("modificationTime").cast("double").alias("us")).select("path", "size", (F.col("us") / 1e6).alias("mtime"))


SCHEMA = "path string, size bigint, mtime double, arrived bigint"


def latest(manifest: DataFrame) -> DataFrame:
    """An append-only manifest read as one row for each path: the one recorded last (by mtime where the order is not kept)."""
    order = "arrived" if "arrived" in manifest.columns else "mtime"
    return manifest.groupBy("path").agg(F.max_by(F.struct("size", "mtime"), order).alias("kept_row")).select("path", "kept_row.*")


def changed(files: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Files that are new, or whose size or mtime differs; all with ``force``."""
    if force:
        return files
    m = manifest.select(F.col("path").alias("p"), F.col("size").alias("s"), F.col("mtime").alias("m"))
    same = (F.col("path") == F.col("p")) & (F.col("size") == F.col("s")) & (F.abs(F.col("mtime") - F.col("m")) < MTIME_TOLERANCE)
    return files.join(m, same, "left_anti")


def record(manifest_path: str, files: DataFrame, arrived: int) -> None:
    """Append what was read; ``latest`` resolves repeats."""
    files.select("path", "size", "mtime", F.lit(arrived).cast("bigint").alias("arrived")).write.mode("append").parquet(manifest_path)
