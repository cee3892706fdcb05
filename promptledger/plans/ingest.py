"""From files and log payloads to the ledger and its wide rows.

Both feeds append keyed batches (bronze). ``refresh`` folds a batch into the store's
deciding rows and recomputes the wide rows that it touches (gold), late records
included; it reads and rewrites only the touched buckets. ``silver`` merges all of a
store on read: what is folded, and the batches that are not. One process refreshes a
store at a time.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import islice

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attribution, blocks, merge, pricing
from ..operators.prompts import Ledger
from ..sources import manifest, sinks, storage, transcripts
from . import store
from .store import FACTS, FEEDS, TABLES

#: Files whose names the driver hands to one scan at most.
FILES_PER_SCAN = 10_000


def silver(spark: SparkSession, root: str, rates: DataFrame | None = None, promos: DataFrame | None = None) -> Ledger:
    """The ledger of both feeds; without ``rates`` and ``promos``, the built-in rate card."""
    return _ledger(spark, {name: merge.MERGES[name](store.rows_of(spark, root, name)) for name in TABLES}, rates, promos)


def _ledger(spark: SparkSession, merged: dict[str, DataFrame], rates: DataFrame | None, promos: DataFrame | None) -> Ledger:
    return Ledger(
        prompts=lambda: attribution.asof_canonical(merged["prompts"]), requests=merged["api_requests"], tool_calls=merged["tool_calls"], edits=merged["edits"], sessions=merged["sessions"],
        rates=pricing.default_rates(spark) if rates is None else rates, promos=pricing.default_promos(spark) if promos is None else promos,
    )


def opened(spark: SparkSession, root: str) -> str:
    """The manifest's folder of this version. A store of a newer version is refused; one of an older
    version gets a new, empty manifest, so every file is read once more."""
    versions = store.read(spark, f"{root}/version", "version int")
    found = versions.agg(F.max("version")).first()[0]
    if found is not None and found > sinks.SCHEMA_VERSION:
        raise ValueError(f"table version {found} is newer than {sinks.SCHEMA_VERSION}")
    if found != sinks.SCHEMA_VERSION:
        spark.createDataFrame([(sinks.SCHEMA_VERSION,)], "version int").write.mode("append").parquet(f"{root}/version")
    return f"{root}/manifest-v{sinks.SCHEMA_VERSION}"


def _part_number(spark: SparkSession, root: str, batch_id: int, digest: str) -> int:
    """The bronze number of a part of a batch, by what the part holds: the same for a part that is
    written again, a new one for any other, so no part ever replaces another's facts."""
    known = store.read(spark, f"{root}/parts", "batch bigint, number bigint, digest string").where(F.col("batch") == batch_id).collect()  # parts of one batch
    for r in known:
        if r["digest"] == digest:
            return r["number"]
    number = max([r["number"] + 1 for r in known], default=batch_id * 1_000_000)
    spark.createDataFrame([(batch_id, number, digest)], "batch bigint, number bigint, digest string").write.mode("append").parquet(f"{root}/parts")
    return number


def reconcile(spark: SparkSession, files: str, root: str, batch_id: int, arrived: int, pattern: str = "*.jsonl", force: bool = False) -> DataFrame:
    """Read the transcripts below ``files`` that changed, append their facts to the store ``root``, record them.

    Returns ``measure, n``: files scanned and ingested, rows of each merged table. ``arrived``
    orders batches of both feeds. A part of the files is numbered by its names, sizes and
    times, and recorded after all of its facts: a run that dies leaves the parts that are
    recorded as they are, and reads the others again, into the same places if nothing
    changed and into new ones if something did; a forced run always takes new ones.
    """
    known = opened(spark, root)
    there = storage.written(manifest.listing(spark, files, pattern), "listing")
    todo = storage.written(manifest.changed(there, manifest.latest(store.read(spark, known, manifest.SCHEMA)), force), "changed")
    salt, rows = uuid.uuid4().hex if force else "", todo.orderBy("path").toLocalIterator()
    while some := list(islice(rows, FILES_PER_SCAN)):
        digest = xxhash.xxh3_128_hexdigest(repr([salt, arrived, *map(tuple, some)]))
        number = _part_number(spark, root, batch_id, digest)
        entries = transcripts.scan(spark, [r["path"] for r in some], pattern)
        owned = transcripts.attributed(entries)
        facts = {
            "prompts": transcripts.prompts(entries), "api_requests": transcripts.requests(entries, owned), "tool_calls": transcripts.tool_calls(entries, owned),
            "edits": transcripts.edits(entries, owned), "sessions": transcripts.sessions(entries),
        }
        for name, found in facts.items():
            placed = found.withColumnsRenamed({"path": "place", "line_no": "ordinal"}).withColumn("arrived", F.lit(arrived).cast("bigint"))
            sinks.append_batch(placed, f"{root}/{FEEDS[0]}/{name}", number)
        manifest.record(known, todo.where((F.col("path") >= some[0]["path"]) & (F.col("path") <= some[-1]["path"])), arrived)
    x, merged_prompts = silver(spark, root), merge.merge_prompts(store.rows_of(spark, root, "prompts"))
    counts = {"scanned": there, "ingested": todo, "prompts": merged_prompts, "api_requests": x.requests, "tool_calls": x.tool_calls, "edits": x.edits, "sessions": x.sessions}
    parts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n") for name, rows in counts.items()]
    return reduce(DataFrame.unionByName, parts)


def _sum_hours(batch: store.Batch, rates: DataFrame, promos: DataFrame, tag: str) -> None:
    """Add to the store's hours what the batch changes in them: its requests as they are merged with it, less as they were without.

    Written before the batch is folded, and once: a refresh that is done again finds its ``tag``.
    """
    spark, root = batch.spark, batch.root
    if not store.read(spark, f"{root}/hours-done", "tag string").where(F.col("tag") == tag).isEmpty():
        return
    hours = lambda rows: blocks.hourly(pricing.costed(merge.merge_requests(rows), rates, promos), [])
    sums = ("out_tokens", "micro_usd", "requests")
    less = hours(batch.before("api_requests")).withColumns({c: -F.col(c) for c in sums}).withColumn("last_ts", F.lit(None).cast("timestamp_ntz"))
    change = hours(batch.after("api_requests")).unionByName(less).groupBy("hour").agg(*[F.sum(c).alias(c) for c in sums], F.max("last_ts").alias("last_ts"))
    change = change.withColumns({"tag": F.lit(tag), "day": F.floor(F.col("hour") / 24).cast("int"), "micro_usd": F.col("micro_usd").cast("decimal(24,6)")})
    change = storage.written(change, "hours")
    days = store.numbers(change, "day")
    held = store.read(spark, f"{root}/hours", HOURS).where((F.col("day").isin(days) if days else F.lit(False)) & (F.col("tag") != tag))
    store.replace_parts(storage.written(held.unionByName(change), "hours"), f"{root}/hours", "day")
    spark.createDataFrame([(tag,)], "tag string").write.mode("append").parquet(f"{root}/hours-done")


HOURS = "hour bigint, out_tokens bigint, micro_usd decimal(24,6), requests bigint, last_ts timestamp_ntz, tag string, day int"
NAMES = "project string, session_id string, display string, arrival_seq struct<arrived: bigint, batch_id: bigint, place: string, ordinal: bigint>, bucket int"


def _name_projects(batch: store.Batch) -> None:
    """Keep for each project the session that arrived last, with its display as it is now."""
    spark, root = batch.spark, batch.root
    x = Ledger(None, None, None, None, merge.merge_sessions(batch.after("sessions")), None, None)
    now = x.session_projects.where("coalesce(project, '') <> '' and coalesce(display, '') <> ''").withColumn("bucket", store.bucket_of(F.col("project"), batch.n))
    now = storage.written(now.select("project", "session_id", "display", "arrival_seq", "bucket"), "names")
    touched = store.numbers(now, "bucket")
    held = store.read(spark, f"{root}/names", NAMES).where(F.col("bucket").isin(touched) if touched else F.lit(False))
    both = held.withColumn("new", F.lit(0)).unionByName(now.withColumn("new", F.lit(1)))
    order = F.struct("arrival_seq", "session_id", "new")
    best = both.groupBy("project", "bucket").agg(F.max_by(F.struct("session_id", "display", "arrival_seq"), order).alias("s")).select("project", "s.*", "bucket")
    store.replace_parts(storage.written(best, "names"), f"{root}/names", "bucket")


def _touched_ledger(batch: store.Batch, rates: DataFrame, promos: DataFrame) -> tuple[Ledger, DataFrame]:
    """The ledger of the prompts that a folded batch touches, and ``touched(id)``.

    Touched are the prompts of the batch's facts, and of the same facts as they were
    before; and all of the sessions in which a prompt came or was late (others may now
    fold into it). The index tells which buckets hold their sessions' prompts and their facts.
    """
    spark, root, n = batch.spark, batch.root, batch.n
    one = lambda rows, column, name="id": rows.select(F.col(column).alias(name)).where(f"{name} is not null").distinct()
    came = storage.written(one(batch.after("prompts"), "session_id"), "came-sessions")
    ids = storage.written(reduce(DataFrame.union, [one(batch.after(name), "prompt_id") for name in ("prompts", *FACTS)]).distinct(), "touched-ids")
    at_ids = store.numbers(ids.select(store.bucket_of(F.col("id"), n).alias("b")), "b")
    own = store.deciding(spark, root, "prompts", at_ids).join(ids.withColumnRenamed("id", "prompt_id"), "prompt_id", "left_semi")
    sessions = storage.written(came.union(one(own, "session_id")).distinct(), "near-sessions")
    near = store.deciding(spark, root, "prompts", sorted({*at_ids, *store.numbers(store.indexed(spark, root, "session", sessions), "bucket")}))
    keys = one(near.join(sessions.withColumnRenamed("id", "session_id"), "session_id", "left_semi"), "prompt_id", "prompt_id").union(ids).distinct()
    prompts = storage.written(attribution.asof_canonical(merge.merge_prompts(near.drop("bucket").join(keys, "prompt_id", "left_semi"))), "near-prompts")
    targets = attribution.targets(prompts)
    direct = ids.union(one(prompts.join(came.withColumnRenamed("id", "session_id"), "session_id", "left_semi"), "prompt_id")).distinct()
    both = direct.withColumnRenamed("id", "prompt_id").join(targets, "prompt_id", "left")
    touched = storage.written(both.select(F.explode(F.array_distinct(F.array_compact(F.array("prompt_id", "target")))).alias("id")).distinct(), "touched")
    members = touched.union(one(targets.join(touched.withColumnRenamed("id", "target"), "target", "left_semi"), "prompt_id")).distinct()
    where = storage.written(store.indexed(spark, root, "prompt", storage.written(members, "members")), "fact-buckets")
    merged = {"prompts": prompts}

    def load(name: str) -> None:
        rows, key = store.deciding(spark, root, name, store.numbers(where.where(F.col("name") == name), "bucket")).drop("bucket"), merge.DECIDING[name][0]
        rows = rows.withColumn("own_key", F.coalesce(F.col(key), F.to_json("arrival_seq")))
        wanted = one(rows.join(members.withColumnRenamed("id", "prompt_id"), "prompt_id", "left_semi"), "own_key", "own_key")
        merged[name] = storage.written(merge.MERGES[name](rows.join(wanted, "own_key", "left_semi").drop("own_key")), f"near-{name}")

    store.at_once(spark, load, FACTS)
    shown = storage.written(one(prompts, "session_id").union(one(merged["api_requests"], "session_id")).distinct(), "shown-sessions")
    held = store.deciding(spark, root, "sessions", store.numbers(shown.select(store.bucket_of(F.col("id"), n).alias("b")), "b")).drop("bucket")
    merged["sessions"] = merge.merge_sessions(held.join(shown.withColumnRenamed("id", "session_id"), "session_id", "left_semi"))
    x = Ledger(prompts=prompts, requests=merged["api_requests"], tool_calls=merged["tool_calls"], edits=merged["edits"], sessions=merged["sessions"], rates=rates, promos=promos)
    x.__dict__["project_names"] = store.read(spark, f"{root}/names", NAMES).select("project", F.col("display").alias("name"))
    return x, touched


def refresh(spark: SparkSession, root: str, feed: str, first: int, last: int, now: str, rates: DataFrame | None = None, promos: DataFrame | None = None) -> None:
    """After batches ``first`` to ``last`` of a feed: fold them, write the wide rows that they touch, and the current block.

    What is read and rewritten are the buckets of the batches' keys and of the touched
    prompts' facts, never the whole store. Rows that are no longer there are written as
    absent. A refresh that died can be done again.
    """
    rates = pricing.default_rates(spark) if rates is None else rates
    promos = pricing.default_promos(spark) if promos is None else promos
    batch = store.Batch(spark, root, feed, first, last)
    if batch.came:
        if "api_requests" in batch.came:
            _sum_hours(batch, rates, promos, f"{feed}:{first}-{last}")
        batch.fold()
        if "sessions" in batch.came:
            _name_projects(batch)
        x, touched = _touched_ledger(batch, rates, promos)
        rows = touched.join(x.only(touched.withColumnRenamed("id", "target")).usage().withColumn("present", F.lit(True)), "id", "left")
        rows = rows.withColumns({"present": F.coalesce("present", F.lit(False)), "bucket": store.bucket_of(F.col("id"), batch.n)})
        rows = storage.written(rows, "wide-rows")
        held = store.read(spark, f"{root}/gold/rows", _ddl(rows)).where(F.col("bucket").isin(at) if (at := store.numbers(rows, "bucket")) else F.lit(False))
        store.replace_parts(storage.written(held.join(touched, "id", "left_anti").unionByName(rows), "wide-rows"), f"{root}/gold/rows", "bucket")
    write_block(spark, root, now)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)


def write_block(spark: SparkSession, root: str, now: str) -> None:
    """The block that ``now`` is in, from the hours of the last days alone; a clock may call it without a batch."""
    at = F.lit(now).cast("timestamp_ntz")
    first = F.timestamp_add("HOUR", F.lit(-blocks.LOOKBACK_HOURS), at)
    recent = store.read(spark, f"{root}/hours", HOURS).where(F.col("day") >= F.floor(blocks.hour_number(first) / 24))
    sums = recent.groupBy("hour").agg(*[F.sum(c).alias(c) for c in ("out_tokens", "micro_usd", "requests")], F.max("last_ts").alias("last_ts"))
    seen = sums.where((F.col("requests") > 0) & (F.col("last_ts") >= first))
    rows = blocks.current(blocks.chained(seen, []), at)
    storage.written(rows, "block").write.mode("overwrite").parquet(f"{root}/gold/block")


def usage(spark: SparkSession, root: str) -> DataFrame:
    """The wide rows as they were last refreshed."""
    return spark.read.parquet(f"{root}/gold/rows").where("present").drop("present", "bucket")


def current_block(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/gold/block")
