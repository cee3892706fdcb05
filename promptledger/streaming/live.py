"""Live ingest of log payloads with Structured Streaming."""

from __future__ import annotations

import time
from bisect import bisect_right
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources import otlp, sinks

TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {"prompts": otlp.prompts, "api_requests": otlp.requests, "tool_calls": otlp.tool_calls}
REFRESH = "60 seconds"


def payload_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Payload lines as they arrive, with the place (file and block) of each; gzip is read as such."""
    place = F.concat_ws(":", F.col("_metadata.file_path"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"))
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).select("value", place.alias("place"))


def arrival(spark: SparkSession, root: str, batch_id: int, clock: Callable[[], int]) -> int:
    """When a batch came first: a replay is told the same."""
    path, schema = f"{root}/arrived/batch_id={batch_id}", "arrived bigint"
    try:
        known = spark.read.schema(schema).parquet(path).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    if known is None:
        came = clock()
        spark.createDataFrame([(came,)], schema).write.mode("overwrite").parquet(path)
        return came
    return known[0]


def ingest(payloads: DataFrame, root: str, checkpoint: str, after: Callable[[int], None] | None = None, clock: Callable[[], int] = lambda: time.time_ns() // 1000, **trigger):
    """Append each batch to the tables below ``root``, once for each batch id; then call ``after`` with it.

    ``after`` is where ``plans.ingest.refresh`` recomputes what the batch touches, late
    records included, and the current block. ``clock`` orders batches of both feeds; within
    a batch, records are ordered by file, block and place in it. A replayed batch is written
    as it was, with the same order. Empty batches do nothing.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        placed = batch if "place" in batch.columns else batch.withColumn("place", F.lit(""))
        records = otlp.log_records(placed).withColumn("ordinal", F.monotonically_increasing_id()).persist()
        try:
            if records.isEmpty():
                return
            came = arrival(spark, root, batch_id, clock)
            for name, table in TABLES.items():
                sinks.append_batch(table(records).withColumn("arrived", F.lit(came).cast("bigint")), f"{root}/{name}", batch_id)
        finally:
            records.unpersist()
        if after:
            after(batch_id)

    return payloads.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": REFRESH})).start()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """An ingested table with its ``arrival_seq``."""
    rows = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
    return rows.withColumn("arrival_seq", F.struct("arrived", "batch_id", "place", "ordinal"))


FOLDED = "prompt_id string, session_id string, ts timestamp, canonical_id string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Typed prompts are kept for a week after they came.
KEEP_MS = 7 * 24 * 3_600_000
_HOUR = 3_600_000_000
#: The key of typed prompts without a ts, before all hours.
_NO_HOUR = -(1 << 62)


class TypedPrompts(StatefulProcessor):
    """A session's typed prompts by hour, each entry dropped ``keep_ms`` after its hour was last written.

    An injected prompt is looked up in its hour, then in the latest hour before it that is
    kept, last among prompts without a ts; one without a ts finds only those. So it finds
    the latest typed prompt that has arrived at or before it, in whatever order prompts come.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hours = handle.getMapState("hours", "hour bigint", "us array<bigint>, ids array<string>", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """The kept hours are asked for once and read where they are needed: each call goes to the JVM and back."""
        came = [(r["us"], r["injected"], r["prompt_id"]) for r in rows]
        held = {h for (h,) in self.hours.keys()}
        typed: dict[int, set[tuple[int, str]]] = {}
        for us, injected, prompt_id in came:
            if not injected:
                typed.setdefault(_NO_HOUR if us is None else us // _HOUR, set()).add((0 if us is None else us, prompt_id))
        read: dict[int, list[tuple[int, str]]] = {}
        for hour, prompts in typed.items():
            read[hour] = sorted(prompts.union(self._at(hour)) if hour in held else prompts)
            self.hours.updateValue((hour,), tuple(map(list, zip(*read[hour]))))
        known = sorted(held.union(typed))
        for us, injected, prompt_id in came:
            if injected:
                yield Row(prompt_id=prompt_id, session_id=key[0], us=us, canonical_id=self._latest(us, known, read))

    def _at(self, hour: int) -> list[tuple[int, str]]:
        """What is held of an hour; nothing if it has expired since."""
        held = self.hours.getValue((hour,))
        return list(zip(*held)) if held else []

    def _latest(self, us: int | None, known: list[int], read: dict[int, list[tuple[int, str]]]) -> str | None:
        last = _NO_HOUR if us is None else us // _HOUR
        for k in range(bisect_right(known, last) - 1, -1, -1):
            hour = known[k]
            if hour not in read:
                read[hour] = sorted(self._at(hour))
            at = len(read[hour]) if hour < last or us is None else bisect_right(read[hour], us, key=lambda p: p[0])
            if at:
                return read[hour][at - 1][1]
        return None

    def close(self) -> None:
        pass


def asof_stream(prompts: DataFrame, keep_ms: int = KEEP_MS) -> DataFrame:
    """Injected prompts with the latest typed prompt of their session that has arrived, at or before them.

    Typed prompts of the same batch have arrived. It equals the batch form over what had
    arrived within ``keep_ms``, also where prompts come out of order. The session's state
    store becomes RocksDB, which this state needs; batches without data are turned off,
    since state with a time to live asks for them for ever. Entries expire as others come.
    """
    conf = prompts.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    rows = prompts.where("session_id is not null").select("session_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "injected", "prompt_id")
    found = rows.groupBy("session_id").transformWithState(statefulProcessor=TypedPrompts(keep_ms), outputStructType="prompt_id string, session_id string, us bigint, canonical_id string", outputMode="Append", timeMode="ProcessingTime")
    return found.select("prompt_id", "session_id", F.timestamp_micros("us").alias("ts"), "canonical_id")
