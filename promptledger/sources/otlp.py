"""OpenTelemetry log payloads as rows, batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_injected, parse_ts

_VALUE = "struct<stringValue: string, intValue: string, doubleValue: double, boolValue: boolean>"
PAYLOAD = f"struct<resourceLogs: array<struct<scopeLogs: array<struct<logRecords: array<struct<body: struct<stringValue: string>, attributes: array<struct<key: string, value: {_VALUE}>>>>>>>>>"
#: The log bodies that are read and the table of each.
EVENTS = {"claude_code.user_prompt": "prompts", "claude_code.api_request": "api_requests", "claude_code.tool_result": "tool_calls"}


def log_records(payloads: DataFrame, column: str = "value") -> DataFrame:
    """body and attrs of every log record of payload lines; ``batch`` columns stay. Malformed payloads have none."""
    rest = [c for c in payloads.columns if c != column]
    parsed = payloads.select(*rest, F.from_json(column, PAYLOAD).alias("p"))
    scopes = parsed.select(*rest, F.explode("p.resourceLogs.scopeLogs").alias("s")).select(*rest, F.explode(F.col("s.logRecords")).alias("r"))
    records = scopes.select(*rest, F.posexplode("r").alias("ordinal", "rec"))
    return records.select(*rest, "ordinal", F.coalesce("rec.body.stringValue", F.lit("")).alias("body"), attributes(F.col("rec.attributes")).alias("attrs"))


def attributes(entries: Column) -> Column:
    """Map of key to value; of the kinds string, integer, double, boolean the first present counts, other kinds are dropped, the last of equal keys wins."""
    known = F.filter(entries, lambda a: F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["doubleValue"].cast("string"), a["value"]["boolValue"].cast("string")).isNotNull() & a["key"].isNotNull())
    pairs = F.transform(known, lambda a: F.struct(a["key"], a["value"]))
    # only a record that repeats a key, which is rare, is searched for the last of each
    last = F.filter(pairs, lambda a, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda b: b["key"] == a["key"]))
    keys = F.transform(known, lambda a: a["key"])
    return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(keys), pairs).otherwise(last))


def text(attrs: Column, key: str) -> Column:
    v = F.element_at(attrs, F.lit(key))
    return F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))


def number(attrs: Column, key: str, kind: str = "bigint") -> Column:
    return text(attrs, key).try_cast(kind)


def route(body: Column, events: dict[str, str] = EVENTS) -> Column:
    """The table that an event belongs to, by its whole body; null for other events."""
    found = F.lit(None).cast("string")
    for event, table in events.items():
        found = F.when(body == event, F.lit(table)).otherwise(found)
    return found


def _place(records: DataFrame) -> list[str]:
    """Where a record came from, if the records tell."""
    return ["place", "ordinal"] if "place" in records.columns else []


def _common(a: Column) -> list[Column]:
    return [text(a, "prompt.id").alias("prompt_id"), text(a, "session.id").alias("session_id"), parse_ts(text(a, "event.timestamp")).alias("ts")]


def prompts(records: DataFrame) -> DataFrame:
    a, said = F.col("attrs"), F.coalesce(text(F.col("attrs"), "prompt"), F.lit(""))
    rows = records.where(route(F.col("body")) == "prompts")
    return rows.select(*_common(a), F.lit(None).cast("string").alias("project"), said.alias("text"), F.lit("otel").alias("source"), is_injected(said).cast("int").alias("injected"), *_place(records))


def requests(records: DataFrame) -> DataFrame:
    """Missing token counts are 0, the cache-write split is unknown (0); cost and duration as given."""
    a = F.col("attrs")
    n = lambda key, name: F.coalesce(number(a, key), F.lit(0).cast("bigint")).alias(name)
    return records.where(route(F.col("body")) == "api_requests").select(
        text(a, "request_id").alias("request_id"), *_common(a), F.coalesce(text(a, "model"), F.lit("?")).alias("model"), n("input_tokens", "input_tokens"), n("output_tokens", "output_tokens"),
        n("cache_read_tokens", "cache_read_tokens"), n("cache_creation_tokens", "cache_create_tokens"), F.lit(0).cast("bigint").alias("cache_5m_tokens"), F.lit(0).cast("bigint").alias("cache_1h_tokens"),
        number(a, "cost_usd", "double").alias("cost_usd"), number(a, "duration_ms").alias("duration_ms"), text(a, "query_source").alias("query_source"), text(a, "agent.name").alias("agent_name"), F.lit("otel").alias("source"), *_place(records),
    )


def tool_calls(records: DataFrame) -> DataFrame:
    a = F.col("attrs")
    key = text(a, "tool_use_id")
    rows = records.where((route(F.col("body")) == "tool_calls") & (F.coalesce(key, F.lit("")) != ""))
    return rows.select(key.alias("tool_use_id"), *_common(a), F.coalesce(text(a, "tool_name"), F.lit("?")).alias("tool_name"), text(a, "agent.name").alias("agent_name"), F.lit("otel").alias("source"), F.lit(None).cast("string").alias("detail"), *_place(records))
