"""Queries over files and streams: Spark writes them from the tables, then reads them as the sources do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import blocks, merge, report
from ..sources import fixtures, otlp, sinks, storage, transcripts
from ..streaming import live
from . import ingest, store
from .oracle import NOW, current_block_sql, sql


#: Lines of a payload file at most: files come in proportion to the lines, so that a batch of some is many tasks.
FILE_LINES = 50_000


def write_transcripts(spark: SparkSession, sf_dir: str) -> str:
    """Conversations as transcript lines, one folder for each project."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pid = F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn")
    human = F.col("role") == "user"
    usage = F.struct(F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens"))
    line = F.to_json(F.struct(
        F.when(human, "user").otherwise("assistant").alias("type"), F.when(human, F.struct(F.lit("human").alias("kind"))).alias("origin"), F.when(human, pid).alias("promptId"),
        F.concat(F.lit("2024-01-01T00:00:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit("Z")).alias("timestamp"), F.when(~human, pid).alias("requestId"),
        F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content"), F.when(~human, usage).alias("usage"), F.when(~human, "m-opus-4-5").alias("model")).alias("message"),
    ))
    path = storage.fresh_path(spark, "transcripts")
    rows = c.select(F.concat(F.lit("proj"), F.col("conv_id") % 7).alias("project"), "conv_id", "turn", line.alias("value"))
    rows.repartition("project").sortWithinPartitions("project", "conv_id", "turn").select("project", "value").write.partitionBy("project").text(path)
    return path


def transcript_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests found in the files, with the prompt above them."""
    entries = transcripts.scan(spark, write_transcripts(spark, sf_dir), "*.txt")
    return transcripts.requests(entries, transcripts.attributed(entries)).select("request_id", "prompt_id", "model", "input_tokens", "output_tokens")


def transcript_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.prompts(transcripts.scan(spark, write_transcripts(spark, sf_dir), "*.txt")).select("prompt_id", "text")


def _attribute(key: str, value, kind: str = "stringValue"):
    v = {k: F.lit(None).cast("string") for k in ("stringValue", "intValue")} | {"doubleValue": F.lit(None).cast("double"), "boolValue": F.lit(None).cast("boolean")}
    return F.struct(F.lit(key).alias("key"), F.struct(*[(value if k == kind else x).alias(k) for k, x in v.items()]).alias("value"))


def write_payloads(spark: SparkSession, sf_dir: str, which: str = "true", path: str | None = None) -> str:
    """Events (those of ``which``) as log payloads, one record each, added to ``path`` or in a new folder."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where(which)
    body = F.concat(F.lit("claude_code."), F.when(F.col("event_type") == "signup", "user_prompt").when(F.col("event_type").isin("view", "click"), "api_request").when(F.col("event_type") == "purchase", "tool_result").otherwise("other"))
    eid, k = F.col("event_id").cast("string"), F.regexp_extract("props", "([0-9]+)", 1)
    attrs = F.array(
        _attribute("event.timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")), _attribute("session.id", F.concat(F.lit("s"), "user_id")), _attribute("prompt.id", F.concat(F.lit("p"), eid)),
        _attribute("request_id", F.concat(F.lit("r"), eid)), _attribute("tool_use_id", F.concat(F.lit("t"), eid)), _attribute("input_tokens", k, "intValue"), _attribute("cost_usd", F.col("value"), "doubleValue"),
        _attribute("prompt", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("  <system-reminder> "), k)).otherwise(k)),
    )
    record = F.struct(F.struct(body.alias("stringValue")).alias("body"), attrs.alias("attributes"))
    payload = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs")))
    path = path or storage.fresh_path(spark, "payloads")
    e.select(payload.alias("value")).write.mode("append").option("maxRecordsPerFile", FILE_LINES).text(path, compression="gzip")
    return path


def _batch_files(spark: SparkSession) -> int:
    """Files of a batch that give every core one (a compressed file is one task), two at least."""
    return max(2, spark.sparkContext.defaultParallelism)


def otlp_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = otlp.log_records(spark.read.text(write_payloads(spark, sf_dir)))
    return otlp.requests(records).select("request_id", "prompt_id", "session_id", "ts", "model", "input_tokens", "output_tokens", "cost_usd")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payloads through the stream; the tables it leaves, counted by session."""
    root = storage.fresh_path(spark, "live")
    query = live.ingest(live.payload_stream(spark, write_payloads(spark, sf_dir), _batch_files(spark)), root, f"{root}-checkpoint", availableNow=True)
    query.awaitTermination()
    parts = [live.table(spark, root, t).groupBy("session_id").agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "session_id", "n") for t in live.TABLES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _folded_prompts(spark: SparkSession, sf_dir: str, batches: tuple[str, ...]) -> DataFrame:
    """Injected prompts as the stream folds them, where the prompts of each of ``batches`` (conditions) arrive after those before."""
    path, out = storage.fresh_path(spark, "prompts"), storage.fresh_path(spark, "folded")
    merged = merge.merge_prompts(fixtures.sources(spark, sf_dir)["fx_prompts_src"])
    fx = storage.written(merged.select("session_id", "ts", "injected", "prompt_id"), "all-prompts")
    for batch in batches:  # a batch is what arrived since the last one, in as many files as it is tasks
        fx.where(batch).write.mode("append").parquet(path)
        stream = live.asof_stream(spark.readStream.schema(fx.schema).parquet(path))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(live.FOLDED).parquet(out).select("prompt_id", "session_id", "canonical_id")


def stream_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injected prompts folded as they arrive, in three batches by time: equal to the batch form."""
    return _folded_prompts(spark, sf_dir, ("ts is null or ts < '2024-01-11'", "ts >= '2024-01-11' and ts < '2024-01-21'", "ts >= '2024-01-21'"))


def stream_asof_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injected prompts as they are folded where prompts come out of order, in four batches: by what had arrived."""
    return _folded_prompts(spark, sf_dir, tuple(f"cast(substring(prompt_id, 2, 20) as bigint) % 4 = {batch}" for batch in (2, 0, 3, 1)))


def _payload(spark: SparkSession, sf_dir: str) -> str:
    x, path = fixtures.ledger(spark, sf_dir, stored=True), storage.fresh_path(spark, "payload")
    sinks.write_payload(x.usage(), blocks.current_block(x.costed, F.lit(NOW).cast("timestamp_ntz")), path, NOW)
    return sinks.payload_folder(spark, path)


def payload_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload's rows as they are read back; ``place`` is their place by ts, latest first."""
    rows = spark.read.schema("id string, project string, ts timestamp_ntz, cost double, api_calls bigint").json(f"{_payload(spark, sf_dir)}/rows")
    place = F.dense_rank().over(Window.orderBy(F.desc("ts"), "id"))
    return rows.select("id", "project", "cost", "api_calls", place.cast("long").alias("place"))


def payload_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload's current block as it is read back."""
    rows = spark.read.schema("block_start timestamp_ntz, out_tokens bigint, cost double, requests bigint, generated_at string").json(f"{_payload(spark, sf_dir)}/window")
    return rows.select(F.date_format("block_start", "yyyy-MM-dd HH:mm:ss").alias("block_start"), "out_tokens", "cost", "requests", "generated_at")


def digest_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two digests of one week, the second suffixed, read back as the index names them."""
    x, root = fixtures.ledger(spark, sf_dir, stored=True), storage.fresh_path(spark, "digests")
    week = report.by_day(report.trailing_days(x.usage(), F.lit(NOW).cast("timestamp_ntz")))
    first = sinks.write_digest(week, root, "2024-W05", "235900")
    sinks.write_digest(spark.read.parquet(first), root, "2024-W05", "235901")
    return spark.read.parquet(root).join(sinks.digest_index(spark, root), "digest").select("digest", "day", "prompts", "out_tokens", "cost")


def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.fresh_path(spark, "csv")
    sinks.write_csv(fixtures.ledger(spark, sf_dir, stored=True).usage(), path)
    return spark.read.option("header", "true").csv(path).select("id", F.col("cost").cast("double").alias("cost"), F.col("c_read").cast("double").alias("c_read"))


def _turn(kind: str = "c") -> Column:
    return F.concat(F.lit(kind), "conv_id", F.lit("-"), "turn")


def _second() -> Column:
    return F.concat(F.lit("2024-01-01T00:00:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit("Z"))


def write_sessions(spark: SparkSession, sf_dir: str) -> str:
    """Conversations as transcripts with tool calls, edits and a working directory, and of every eleventh a subagent's transcript."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("project", F.concat(F.lit("a+b "), F.col("conv_id") % 7))
    text = F.struct(F.lit("text").alias("type"), F.col("text"))
    human = F.to_json(F.struct(
        F.lit("user").alias("type"), F.struct(F.lit("human").alias("kind")).alias("origin"), _turn().alias("promptId"), _second().alias("timestamp"),
        F.concat(F.lit("/home/u/w"), F.col("conv_id") % 7).alias("cwd"), F.struct(F.array(text).alias("content")).alias("message"),
    ))
    skill = F.col("turn") % 4 == 3
    tool = F.struct(F.lit("tool_use").alias("type"), _turn("t").alias("id"), F.when(skill, "Skill").otherwise("Edit").alias("name"), F.struct(F.when(skill, "shape").alias("skill")).alias("input"))
    usage = F.struct(F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens"))
    said = lambda content: F.struct(F.array(content).alias("content"), usage.alias("usage"), F.lit("claude-opus-4-5").alias("model"))
    answer = F.to_json(F.struct(F.lit("assistant").alias("type"), _second().alias("timestamp"), _turn().alias("requestId"), said(tool).alias("message")))
    patch = F.array(F.struct(F.array(F.lit("+one"), F.lit("-two"), F.lit(" three"), F.lit("+")).alias("lines")))
    edit = F.struct(F.concat(F.lit("/src/f"), F.col("conv_id") % 5, F.lit(".py")).alias("filePath"), F.when(~skill, patch).alias("structuredPatch"))
    result = F.to_json(F.struct(
        F.lit("user").alias("type"), _second().alias("timestamp"), F.struct(F.array(F.struct(F.lit("tool_result").alias("type"), _turn("t").alias("tool_use_id"))).alias("content")).alias("message"),
        F.when(~skill, edit).alias("toolUseResult"),
    ))
    lines = F.when(F.col("role") == "user", F.array(human)).otherwise(F.array(answer, result))
    root = storage.fresh_path(spark, "sessions")
    rows = c.select("project", "conv_id", "turn", F.posexplode(lines).alias("k", "value"))
    rows.repartition("project").sortWithinPartitions("project", "conv_id", "turn", "k").select("project", "value").write.partitionBy("project").text(root)
    inner = F.to_json(F.struct(F.lit("assistant").alias("type"), _second().alias("timestamp"), _turn("q").alias("requestId"), F.concat(F.lit("c"), "conv_id", F.lit("-0")).alias("promptId"), said(text).alias("message")))
    c.where("conv_id % 11 = 0 and role <> 'user'").select(inner.alias("value")).write.text(f"{root}/project=a+b 0/s0/subagents")
    return root


def write_answers(spark: SparkSession, sf_dir: str) -> str:
    """Every third answer of the conversations as a live record with a reported cost, and the tool calls of those under a generic name."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role <> 'user' and turn % 3 = 0")
    common = [_attribute("event.timestamp", _second()), _attribute("prompt.id", _turn("live"))]
    request = F.array(*common, _attribute("request_id", _turn()), _attribute("model", F.lit("claude-haiku-4-5")), _attribute("output_tokens", F.lit("7"), "intValue"), _attribute("cost_usd", F.col("turn") / 8, "doubleValue"))
    call = F.array(*common, _attribute("tool_use_id", _turn("t")), _attribute("tool_name", F.lit("mcp_tool")))
    record = lambda event, attrs: F.struct(F.struct(F.lit(f"claude_code.{event}").alias("stringValue")).alias("body"), attrs.alias("attributes"))
    records = F.array(record("api_request", request), record("tool_result", call))
    payload = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(records.alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs")))
    path = storage.fresh_path(spark, "answers")
    c.select(payload.alias("value")).write.option("maxRecordsPerFile", FILE_LINES).text(path)
    return path


def transcript_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = transcripts.scan(spark, write_sessions(spark, sf_dir), "*.txt")
    return transcripts.tool_calls(entries, transcripts.attributed(entries)).select("tool_use_id", "prompt_id", "tool_name", "detail")


def transcript_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = transcripts.scan(spark, write_sessions(spark, sf_dir), "*.txt")
    return transcripts.edits(entries, transcripts.attributed(entries)).select("tool_use_id", "prompt_id", "file_path", "kind", "lines_added", "lines_removed", "chars_added")


def transcript_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.sessions(transcripts.scan(spark, write_sessions(spark, sf_dir), "*.txt")).select("project", "cwd")


def _both_feeds(spark: SparkSession, sf_dir: str, counted: bool = False) -> tuple[str, list[DataFrame]]:
    """A store of live records, then of transcripts, read twice; and the counts of both readings, where they are wanted."""
    root = storage.fresh_path(spark, "store")
    stream = live.ingest(live.payload_stream(spark, write_answers(spark, sf_dir), _batch_files(spark)), f"{root}/live", f"{root}-checkpoint", clock=lambda: 1, availableNow=True)
    stream.awaitTermination()
    files = write_sessions(spark, sf_dir)
    counts = []
    for k in range(2):
        counts.append(ingest.reconcile(spark, files, root, k, 2 + k, "*.txt"))
        if counted:  # before the next reading; the counts merge all of the store
            counts[k] = storage.written(counts[k], "counts")
    return root, counts


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the merged tables after each of two readings; the second finds no file changed."""
    first, second = _both_feeds(spark, sf_dir, counted=True)[1]
    rows = first.withColumn("run", F.lit(1)).union(second.withColumn("run", F.lit(2)))
    return rows.where("measure in ('prompts', 'api_requests', 'tool_calls', 'edits') or (measure = 'ingested' and run = 2)").select("run", "measure", "n")


def silver_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of both feeds and of subagents, merged and priced with the built-in card."""
    x = ingest.silver(spark, _both_feeds(spark, sf_dir)[0])
    return x.costed.select("request_id", "prompt_id", "source", "model", "query_source", "input_tokens", "output_tokens", fn.usd(F.col("micro_usd"), 6).alias("cost"))


def silver_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls of both feeds: the live record came first, the transcript tells the name's detail."""
    return ingest.silver(spark, _both_feeds(spark, sf_dir)[0]).tool_calls.select("tool_use_id", "prompt_id", "tool_name", "detail", "source")


def _new_store(spark: SparkSession) -> str:
    """A store of few buckets, as each batch of these queries touches most keys."""
    root = storage.fresh_path(spark, "store")
    store.buckets(spark, root, 8)
    return root


def live_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide rows that are recomputed batch after batch, from both feeds as they come."""
    root, files = _new_store(spark), write_sessions(spark, sf_dir)
    again = lambda feed: lambda first, last: ingest.refresh(spark, root, feed, first, last, "2024-01-01 04:59:59")
    stream = live.ingest(live.payload_stream(spark, write_answers(spark, sf_dir)), f"{root}/live", f"{root}-checkpoint", after=lambda k: again("live")(k, k), clock=lambda: 1, availableNow=True)
    stream.awaitTermination()
    ingest.reconcile(spark, files, root, 0, 2, "*.txt")
    again("transcripts")(0, 999_999)
    return ingest.usage(spark, root).select("id", "api_calls", "tool_calls", "out_tokens", "cost")


def live_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current block after three batches of live records, the later ones full of late requests."""
    root, path = _new_store(spark), None
    refresh = lambda k: ingest.refresh(spark, root, "live", k, k, NOW)
    for part in (1, 0, 2):
        path = write_payloads(spark, sf_dir, f"event_id % 3 = {part}", path)
        live.ingest(live.payload_stream(spark, path), f"{root}/live", f"{root}-checkpoint", after=refresh, clock=lambda: 1, availableNow=True).awaitTermination()
    rows = ingest.current_block(spark, root)
    return rows.select(F.date_format("block_start", "yyyy-MM-dd HH:mm:ss").alias("block_start"), "out_tokens", "cost", "requests")


def folded_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``silver_union``, where the live feed was folded (twice) and the transcripts were not."""
    root = _both_feeds(spark, sf_dir)[0]
    store.buckets(spark, root, 8)
    for _ in range(2):
        store.Batch(spark, root, "live", 0, 999_999).fold()
    x = ingest.silver(spark, root)
    return x.costed.select("request_id", "prompt_id", "source", "model", "query_source", "input_tokens", "output_tokens", fn.usd(F.col("micro_usd"), 6).alias("cost"))


def forced_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is scanned, ingested and held after a reading, a forced one and one without changes."""
    files, root, out = write_transcripts(spark, sf_dir), storage.fresh_path(spark, "store"), None
    for run, force in ((1, False), (2, True), (3, False)):
        counts = ingest.reconcile(spark, files, root, run, run, "*.txt", force).withColumn("run", F.lit(run))
        counts = storage.written(counts.where("measure in ('scanned', 'ingested', 'prompts', 'api_requests')"), "counts")
        out = counts if out is None else out.unionByName(counts)
    return out.select("run", "measure", "n")


QUERIES = {
    f.__name__: f
    for f in (
        transcript_scan, transcript_prompts, transcript_tools, transcript_edits, transcript_sessions, otlp_scan, stream_ingest, stream_asof, stream_asof_late,
        payload_sink, payload_window, digest_sink, csv_export, reconcile, silver_union, silver_tools, live_refresh, live_block, folded_union, forced_reconcile,
    )
}

_LAST = "last_value(case when role = 'user' then concat('c', conv_id, '-', turn) end ignore nulls) over (partition by conv_id % 7 order by conv_id, turn rows between unbounded preceding and current row)"
#: Answers with a prompt above them in their file.
_SEEN = f"(select * from (select *, {_LAST} as prompt_id from conversations) where role <> 'user' and prompt_id is not null)"
_LIVE = "role <> 'user' and turn % 3 = 0"
#: Requests of both feeds: a live record wins.
_MERGED = f"""select concat('c', conv_id, '-', turn) as request_id, concat('live', conv_id, '-', turn) as prompt_id, 'otel' as source, 'claude-haiku-4-5' as model, null as query_source,
  cast(0 as bigint) as input_tokens, cast(7 as bigint) as output_tokens, turn / 8 as cost_usd from conversations where {_LIVE}
union all select concat('c', conv_id, '-', turn), prompt_id, 'jsonl', 'claude-opus-4-5', 'main', cast(length(text) as bigint), cast(turn as bigint), null from {_SEEN} where turn % 3 <> 0
union all select concat('q', conv_id, '-', turn), concat('c', conv_id, '-0'), 'jsonl', 'claude-opus-4-5', 'subagent', cast(length(text) as bigint), cast(turn as bigint), null from conversations where conv_id % 11 = 0 and role <> 'user'"""
ORACLE_SQL = {
    "transcript_scan": f"""select concat('c', conv_id, '-', turn) as request_id, prompt_id, 'm-opus-4-5' as model, cast(length(text) as bigint) as input_tokens, turn as output_tokens
from (select *, {_LAST} as prompt_id from conversations) where role <> 'user' and prompt_id is not null""",
    "transcript_prompts": "select concat('c', conv_id, '-', turn) as prompt_id, text from conversations where role = 'user'",
    "otlp_scan": """select concat('r', event_id) as request_id, concat('p', event_id) as prompt_id, concat('s', user_id) as session_id, ts, '?' as model,
  cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as input_tokens, cast(0 as bigint) as output_tokens, value as cost_usd from events where event_type in ('view', 'click')""",
    "stream_ingest": """select case when event_type = 'signup' then 'prompts' when event_type = 'purchase' then 'tool_calls' else 'api_requests' end as table_name,
  concat('s', user_id) as session_id, count(*) as n from events where event_type <> 'error' group by all""",
    "stream_asof": sql("select prompt_id, session_id, canonical_id from prompts where injected = 1 and session_id is not null"),
    "stream_asof_late": sql("""select i.prompt_id, i.session_id, max_by(t.prompt_id, (coalesce(t.ts, timestamp '0001-01-01'), t.prompt_id)) as canonical_id
from (select *, case cast(substr(prompt_id, 2) as bigint) % 4 when 2 then 0 when 0 then 1 when 3 then 2 else 3 end as batch from prompts) i
left join (select *, case cast(substr(prompt_id, 2) as bigint) % 4 when 2 then 0 when 0 then 1 when 3 then 2 else 3 end as batch from prompts where injected = 0) t
  on t.session_id = i.session_id and t.batch <= i.batch and (t.ts is null or t.ts <= i.ts) where i.injected = 1 and i.session_id is not null group by all"""),
    "payload_sink": sql("select id, project, cost, api_calls, dense_rank() over (order by ts desc, id) as place from usage"),
    "payload_window": current_block_sql(f"select strftime(block_start, '%Y-%m-%d %H:%M:%S') as block_start, out_tokens, cost, requests, '{NOW}' as generated_at from ({{}})"),
    "digest_sink": sql("select digest, strftime(ts, '%Y-%m-%d') as day, count(*) as prompts, cast(sum(out_tokens) as bigint) as out_tokens, cast(sum(cast(cost as decimal(20,4))) as double) as cost from week, unnest(['2024-W05', '2024-W05-235901']) as t(digest) group by all"),
    "csv_export": sql("select id, cost, c_read from usage"),
    "transcript_tools": f"""select concat('t', conv_id, '-', turn) as tool_use_id, prompt_id, case when turn % 4 = 3 then 'Skill' else 'Edit' end as tool_name,
  case when turn % 4 = 3 then 'shape' end as detail from {_SEEN}""",
    "transcript_edits": f"""select concat('t', conv_id, '-', turn) as tool_use_id, prompt_id, concat('/src/f', conv_id % 5, '.py') as file_path, 'update' as kind,
  cast(2 as bigint) as lines_added, cast(1 as bigint) as lines_removed, cast(3 as bigint) as chars_added from {_SEEN} where turn % 4 <> 3""",
    "transcript_sessions": "select distinct concat('project=a+b ', conv_id % 7) as project, concat('/home/u/w', conv_id % 7) as cwd from conversations",
    "reconcile": f"""with r as (select distinct request_id from ({_MERGED})), t as (select 1 from {_SEEN} union all select 1 from conversations where {_LIVE} and (conv_id, turn) not in (select (conv_id, turn) from {_SEEN}))
select run, measure, case when measure = 'ingested' then 0 when measure = 'prompts' then (select count(*) from conversations where role = 'user')
  when measure = 'api_requests' then (select count(*) from r) when measure = 'tool_calls' then (select count(*) from t) else (select count(*) from {_SEEN} where turn % 4 <> 3) end as n
from unnest([1, 2]) as a(run), unnest(['prompts', 'api_requests', 'tool_calls', 'edits', 'ingested']) as b(measure) where measure <> 'ingested' or run = 2""",
    "silver_union": f"""select request_id, prompt_id, source, model, query_source, input_tokens, output_tokens,
  round(coalesce(cast(cost_usd as decimal(20,9)), cast(input_tokens * 5 + output_tokens * 25 as decimal(24,6)) * cast(0.000001 as decimal(7,6))), 6)::double as cost from ({_MERGED})""",
    "silver_tools": f"""select concat('t', conv_id, '-', turn) as tool_use_id, case when l then concat('live', conv_id, '-', turn) else prompt_id end as prompt_id,
  case when l then 'mcp_tool' when turn % 4 = 3 then 'Skill' else 'Edit' end as tool_name, case when prompt_id is not null and turn % 4 = 3 then 'shape' end as detail, case when l then 'otel' else 'jsonl' end as source
from (select *, turn % 3 = 0 as l from (select *, {_LAST} as prompt_id from conversations) where role <> 'user') where l or prompt_id is not null""",
    "live_refresh": f"""with c as (select prompt_id as id, count(*) as api_calls, cast(sum(output_tokens) as bigint) as out_tokens,
    sum(coalesce(cast(cost_usd * 1000000 as decimal(24,6)), cast(input_tokens * 5 + output_tokens * 25 as decimal(24,6)))) as micro from ({_MERGED}) group by prompt_id),
t as (select case when l then concat('live', conv_id, '-', turn) else prompt_id end as id, count(*) as n
  from (select *, turn % 3 = 0 as l from (select *, {_LAST} as prompt_id from conversations) where role <> 'user') where l or prompt_id is not null group by 1)
select id, coalesce(api_calls, 0) as api_calls, coalesce(n, 0) as tool_calls, coalesce(out_tokens, 0) as out_tokens, cast(round(cast(coalesce(micro, 0) as decimal(24,6)) * cast(0.000001 as decimal(7,6)), 4) as double) as cost
from c full join t using (id)""",
    "live_block": f"""with recursive r as (select ts, cast(cast(value as decimal(20,9)) * 1000000 as decimal(24,6)) as micro from events
    where event_type in ('view', 'click') and ts >= timestamp '{NOW}' - interval 36 hour),
  h as (select distinct date_trunc('hour', ts) as hour from r),
  c(start) as (select min(hour) from h union all select (select min(hour) from h where hour >= start + interval 5 hour) from c where start is not null),
  b as (select max(start) as start from c)
select strftime(start, '%Y-%m-%d %H:%M:%S') as block_start, cast(0 as bigint) as out_tokens, cast(round(cast(sum(micro) as decimal(24,6)) * cast(0.000001 as decimal(7,6)), 4) as double) as cost, count(*) as requests
from b join r on r.ts >= b.start where timestamp '{NOW}' < start + interval 5 hour group by start""",
    "forced_reconcile": f"""select run, measure, case measure when 'prompts' then (select count(*) from conversations where role = 'user') when 'api_requests' then (select count(*) from {_SEEN})
  when 'ingested' then (select count(distinct conv_id % 7) from conversations) * cast(run < 3 as int) else (select count(distinct conv_id % 7) from conversations) end as n
from unnest([1, 2, 3]) as a(run), unnest(['scanned', 'ingested', 'prompts', 'api_requests']) as b(measure)""",
}
ORACLE_SQL["folded_union"] = ORACLE_SQL["silver_union"]
