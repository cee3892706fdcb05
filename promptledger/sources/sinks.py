"""Where results go: the payload, digests, CSV, and keyed bronze batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

SCHEMA_VERSION = 2
#: JSON times as a whole; Spark's own formats cut them to milliseconds.
MICROSECONDS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]"}


def write_payload(rows: DataFrame, window: DataFrame, path: str, generated_at: str) -> None:
    """Rows and current window as JSON lines, replaced as one: both are written into a folder of their own,
    then a line in ``versions``, a single file's commit, makes them the payload. Rows are in order of ts, latest first;
    times keep their microseconds, so readers find the same order."""
    spark, own = rows.sparkSession, f"v-{uuid.uuid4().hex}"
    rows.orderBy(F.desc("ts"), "id").withColumn("generated_at", F.lit(generated_at)).write.options(**MICROSECONDS).json(f"{path}/{own}/rows")
    window.withColumn("generated_at", F.lit(generated_at)).write.options(**MICROSECONDS).json(f"{path}/{own}/window")
    last = max((r["n"] for r in _versions(spark, path)), default=0)
    spark.createDataFrame([(last + 1, own)], "n bigint, folder string").coalesce(1).write.mode("append").json(f"{path}/versions")


def _versions(spark: SparkSession, path: str) -> list:
    try:
        return spark.read.schema("n bigint, folder string").json(f"{path}/versions").orderBy(F.desc("n")).limit(1).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []


def payload_folder(spark: SparkSession, path: str) -> str:
    """The folder (``rows``, ``window``) of the payload that was written last as a whole."""
    found = _versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no payload in {path}")
    return f"{path}/{found[0]['folder']}"


def write_digest(digest: DataFrame, root: str, week: str, suffix: str) -> str:
    """One digest a week, never overwritten: where the week has one, the suffix makes another. Returns its path."""
    path = f"{root}/digest={week}"
    try:
        digest.write.mode("errorifexists").parquet(path)
    except AnalysisException as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
        path = f"{path}-{suffix}"
        digest.write.mode("errorifexists").parquet(path)
    return path


def digest_index(spark: SparkSession, root: str) -> DataFrame:
    """Names of the digests, newest first; no digest is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    return files.select(F.regexp_extract("path", "/digest=([^/]+)/", 1).alias("digest")).where("digest <> ''").distinct().orderBy(F.desc("digest"))


def write_csv(rows: DataFrame, path: str) -> None:
    """The flat view with cost components; lists and maps are left out."""
    flat = [c for c, kind in rows.dtypes if not kind.startswith(("array", "map", "struct"))]
    rows.select(flat).write.mode("overwrite").option("header", "true").csv(path)


def append_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Append a batch once: a replay replaces its own folder."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def upgraded(rows: DataFrame, version: int, columns: dict[str, str]) -> DataFrame:
    """Rows of an older table with missing ``columns`` (name: type) as nulls; a newer version is refused."""
    if version > SCHEMA_VERSION:
        raise ValueError(f"table version {version} is newer than {SCHEMA_VERSION}")
    return rows.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in rows.columns})
