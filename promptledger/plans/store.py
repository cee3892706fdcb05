"""What a store holds between the batches of two feeds and the wide rows.

``<feed>/<table>/batch_id=n``   bronze: batches as they came.
``folded``                      which batches are in ``deciding`` already.
``deciding/<table>/bucket=b``   the rows that decide each key's merged row, by a hash of the key.
``index/kind=k/slot=s``         which buckets hold facts of a prompt or prompts of a session.
``names/bucket=b``              each project's session that arrived last, with its display.
``hours/day=d``                 what each batch added to each hour's requests, tokens and cost.

Folding a batch reads and rewrites only the buckets of its keys. All steps can be done
again: deciding rows of rows that are there already are the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..sources import storage

#: Columns of the bronze tables; a batch without one of them (of an older version) has nulls there.
TABLES = {
    "prompts": "prompt_id string, session_id string, project string, ts timestamp_ntz, text string, source string, injected int",
    "api_requests": """request_id string, prompt_id string, session_id string, ts timestamp_ntz, model string, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint,
        cache_create_tokens bigint, cache_5m_tokens bigint, cache_1h_tokens bigint, cost_usd double, duration_ms bigint, query_source string, agent_name string, source string""",
    "tool_calls": "tool_use_id string, prompt_id string, session_id string, ts timestamp_ntz, tool_name string, agent_name string, source string, detail string",
    "edits": """tool_use_id string, prompt_id string, session_id string, ts timestamp_ntz, file_path string, kind string, lines_added bigint, lines_removed bigint, chars_added bigint,
        agent_name string, source string""",
    "sessions": "session_id string, project string, cwd string",
}
FACTS = ("api_requests", "tool_calls", "edits")
FEEDS = ("transcripts", "live")
#: Buckets of a new store: a bucket is what one touched key costs to read and rewrite, so choose a store's size over some 100 MB.
BUCKETS = 64
#: Tasks that write one part: rows of as many tasks as there are before come to that many at most.
PART_TASKS = 8
_ARRIVED = "arrived bigint, place string, ordinal bigint"
_SEQ = "arrival_seq struct<arrived: bigint, batch_id: bigint, place: string, ordinal: bigint>"


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table below the store, empty where nothing was written yet."""
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def replace_parts(rows: DataFrame, path: str, by: str) -> None:
    """Replace the parts of ``path`` that ``rows`` have (values of ``by``), each by a few files; the other parts stay.

    A part is written by PART_TASKS tasks at most, so few parts of many rows are many tasks.
    """
    salt = F.pmod(F.spark_partition_id(), F.lit(PART_TASKS))
    rows.repartition(F.col(by), salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def buckets(spark: SparkSession, root: str, wanted: int = BUCKETS) -> int:
    """The number of buckets of a store, fixed when it is first asked for."""
    found = read(spark, f"{root}/layout", "buckets int").agg(F.max("buckets")).first()[0]
    if found is None:
        spark.createDataFrame([(wanted,)], "buckets int").write.mode("append").parquet(f"{root}/layout")
    return found or wanted


def bucket_of(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def bronze(spark: SparkSession, root: str, name: str, feed: str) -> DataFrame:
    """The batches of a feed's table with ``arrival_seq``: when its batch came, then file and line or the record's number."""
    rows = read(spark, f"{root}/{feed}/{name}", f"{TABLES[name]}, {_ARRIVED}, batch_id bigint")
    return rows.withColumn("arrival_seq", F.struct("arrived", "batch_id", "place", "ordinal")).drop("arrived", "place", "ordinal")


def folded(spark: SparkSession, root: str, feed: str) -> Column:
    """True for the batch_ids of a feed that are folded; successive ones are one range each."""
    done = sorted(r["batch_id"] for r in read(spark, f"{root}/folded", "feed string, batch_id bigint").where(F.col("feed") == feed).select("batch_id").distinct().toLocalIterator())
    ranges: list[list[int]] = []
    for k in done:
        if ranges and k == ranges[-1][1] + 1:
            ranges[-1][1] = k
        else:
            ranges.append([k, k])
    out = F.lit(False)
    for lo, hi in ranges:
        out = out | F.col("batch_id").between(lo, hi)
    return out


def deciding(spark: SparkSession, root: str, name: str, only: list[int] | None = None) -> DataFrame:
    """The folded rows of a table, of all buckets or of those of ``only``."""
    rows = read(spark, f"{root}/deciding/{name}", f"{TABLES[name]}, {_SEQ}, bucket int")
    return rows if only is None else rows.where(F.col("bucket").isin(only) if only else F.lit(False))


def rows_of(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All rows that may decide a table's merged rows: those folded, and the batches that are not."""
    out = deciding(spark, root, name).drop("bucket")
    for feed in FEEDS:
        out = out.unionByName(bronze(spark, root, name, feed).where(~folded(spark, root, feed)).drop("batch_id"))
    return out


def numbers(rows: DataFrame, column: str) -> list[int]:
    """The different bucket numbers in a column, as many as the store has at most."""
    return sorted(r[0] for r in rows.select(column).distinct().collect())


def at_once(spark: SparkSession, f: Callable[[str], None], names: Iterable[str]) -> None:
    """Call ``f`` for each table's name, the tables' jobs beside each other; the first error is raised."""
    with ThreadPoolExecutor(len(TABLES)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(f), name) for name in names]:
            done.result()


def indexed(spark: SparkSession, root: str, kind: str, ids: DataFrame) -> DataFrame:
    """``name, bucket``: which buckets of which tables may hold rows of ``ids(id)``; only the ids' slots are read."""
    n = buckets(spark, root)
    slots = numbers(ids.select(bucket_of(F.col("id"), n).alias("slot")), "slot")
    index = read(spark, f"{root}/index", "id string, name string, bucket int, kind string, slot int")
    return index.where((F.col("kind") == kind) & (F.col("slot").isin(slots) if slots else F.lit(False))).join(ids, "id", "left_semi").select("name", "bucket").distinct()


class Batch:
    """New rows of each table, and with them the rows that are there already of the same keys."""

    def __init__(self, spark: SparkSession, root: str, feed: str, first: int, last: int):
        self.spark, self.root, self.feed, self.n = spark, root, feed, buckets(spark, root)
        self.new, self.old = {}, {}
        self.came: list[str] = []  # tables with new rows

        def load(name: str) -> None:
            came = bronze(spark, root, name, feed).where(F.col("batch_id").between(first, last))
            own = F.coalesce(F.col(merge.DECIDING[name][0]), F.to_json("arrival_seq"))
            self.new[name] = storage.written(came.withColumn("bucket", bucket_of(own, self.n)), f"new-{name}")
            at = numbers(self.new[name], "bucket")
            held = deciding(spark, root, name, at)
            self.old[name] = storage.written(held, f"old-{name}") if at else held
            if at:
                self.came.append(name)

        at_once(spark, load, TABLES)

    def batch_ids(self) -> DataFrame:
        out = None
        for name in self.came:
            ids = self.new[name].select("batch_id")
            out = ids if out is None else out.union(ids)
        return out.distinct()

    def before(self, name: str) -> DataFrame:
        """The old rows of the batch's keys."""
        key = merge.DECIDING[name][0]
        return self.old[name].drop("bucket").join(self.new[name].select(key).distinct(), key, "left_semi")

    def after(self, name: str) -> DataFrame:
        return self.before(name).unionByName(self.new[name].drop("bucket", "batch_id"))

    def fold(self) -> None:
        """Put the new rows into their buckets, then into the index; then the batches are folded."""

        def put(name: str) -> None:  # from the copies of the old rows, so a part is not read as it is replaced
            rows = merge.deciding(self.old[name].unionByName(self.new[name].drop("batch_id")).drop("bucket"), name)
            own = F.coalesce(F.col(merge.DECIDING[name][0]), F.to_json("arrival_seq"))
            replace_parts(rows.withColumn("bucket", bucket_of(own, self.n)), f"{self.root}/deciding/{name}", "bucket")

        at_once(self.spark, put, self.came)
        entries = [self.new["prompts"].select(F.col("session_id").alias("id"), F.lit("prompts").alias("name"), "bucket", F.lit("session").alias("kind"))]
        entries += [self.new[name].select(F.col("prompt_id").alias("id"), F.lit(name).alias("name"), "bucket", F.lit("prompt").alias("kind")) for name in FACTS]
        rows = entries[0]
        for x in entries[1:]:
            rows = rows.unionByName(x)
        rows = rows.where("id is not null").distinct().withColumn("slot", bucket_of(F.col("id"), self.n))
        rows.repartition("kind", "slot").write.mode("append").partitionBy("kind", "slot").parquet(f"{self.root}/index")
        self.batch_ids().select(F.lit(self.feed).alias("feed"), "batch_id").write.mode("append").parquet(f"{self.root}/folded")


def compact_index(spark: SparkSession, root: str) -> None:
    """Rewrite the index with each entry once: folding appends to it. For an hour without ingest."""
    rows = storage.written(read(spark, f"{root}/index", "id string, name string, bucket int, kind string, slot int").distinct(), "index")
    rows.repartition("kind", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "slot").parquet(f"{root}/index")
