"""Keyed conflict resolution of the two feeds, ordered by ``arrival_seq``.

Each fold is one partial-and-final aggregation, so a replayed or hot key costs
map-side work only. Rows with a null key never conflict and pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIVE = "otel"
OWN = "_own_row"


def _first(column: str, keep: Column | None = None) -> Column:
    """The value of the earliest row that ``keep`` admits (by default: that is not null)."""
    keep = F.col(column).isNotNull() if keep is None else keep
    return F.min(F.when(keep, F.struct("arrival_seq", column)))[column].alias(column)


def _keyed(rows: DataFrame, key: str):
    """Rows grouped by ``key``; each row without one is a group of its own, so they neither meet nor gather in one task."""
    return rows.withColumn(OWN, F.when(F.col(key).isNull(), F.monotonically_increasing_id())).groupBy(key, OWN)


def _rest(rows: DataFrame, *keys: str) -> Column:
    return F.struct(*[c for c in rows.columns if c not in keys])


def merge_prompts(rows: DataFrame) -> DataFrame:
    """First non-null session, project, ts and canonical id; first non-empty text; greatest injected; first source."""
    fill = [_first(c) for c in ("session_id", "project", "ts", "canonical_id") if c in rows.columns]
    text = F.coalesce(_first("text", F.col("text") != ""), _first("text")).alias("text")
    folded = _keyed(rows, "prompt_id").agg(*fill, text, _first("source", F.lit(True)), F.max("injected").alias("injected"), F.min("arrival_seq").alias("arrival_seq"))
    return folded.select(rows.columns)


def merge_requests(rows: DataFrame) -> DataFrame:
    """The last live row whole, nulls included; without one, the first row."""
    whole, at = _rest(rows, "request_id"), F.struct("arrival_seq")
    live = F.max(F.when(F.col("source") == LIVE, F.struct(at.alias("at"), whole.alias("kept_row"))))["kept_row"]
    best = _keyed(rows, "request_id").agg(F.coalesce(live, F.min_by(whole, at)).alias("kept_row"))
    return best.select("request_id", "kept_row.*").select(rows.columns)


def merge_tool_calls(rows: DataFrame) -> DataFrame:
    """First row, but a generic name gives way to the first specific one; detail: first non-null."""
    specific = F.col("tool_name").ilike("mcp__%") & (F.col("tool_name") != "mcp_tool")
    rest = [c for c in rows.columns if c not in ("tool_use_id", "tool_name", "detail")]
    folded = _keyed(rows, "tool_use_id").agg(F.min_by(F.struct(*rest, "tool_name"), F.struct("arrival_seq")).alias("kept_row"), _first("tool_name", specific).alias("specific"), _first("detail"))
    name = F.when(F.col("kept_row.tool_name") == "mcp_tool", F.coalesce("specific", "kept_row.tool_name")).otherwise(F.col("kept_row.tool_name"))
    return folded.select("tool_use_id", name.alias("tool_name"), "detail", *[f"kept_row.{c}" for c in rest]).select(rows.columns)


def merge_edits(rows: DataFrame) -> DataFrame:
    """The first row whole."""
    best = _keyed(rows, "tool_use_id").agg(F.min_by(_rest(rows, "tool_use_id"), F.struct("arrival_seq")).alias("kept_row"))
    return best.select("tool_use_id", "kept_row.*").select(rows.columns)


def merge_sessions(rows: DataFrame) -> DataFrame:
    return rows.where("session_id is not null").groupBy("session_id").agg(_first("project"), _first("cwd"), F.min("arrival_seq").alias("arrival_seq"))


#: For each table its key, and the rows that decide its merged row: the first and the last that meet a condition.
DECIDING: dict[str, tuple[str, list[str], list[str]]] = {
    "prompts": ("prompt_id", ["true", "session_id is not null", "project is not null", "ts is not null", "text <> ''", "text is not null", "injected = 1"], []),
    "api_requests": ("request_id", ["true"], [f"source = '{LIVE}'"]),
    "tool_calls": ("tool_use_id", ["true", "detail is not null", "tool_name ilike 'mcp__%' and tool_name <> 'mcp_tool'"], []),
    "edits": ("tool_use_id", ["true"], []),
    "sessions": ("session_id", ["true", "project is not null", "cwd is not null"], []),
}
MERGES = {"prompts": merge_prompts, "api_requests": merge_requests, "tool_calls": merge_tool_calls, "edits": merge_edits, "sessions": merge_sessions}


def deciding(rows: DataFrame, table: str) -> DataFrame:
    """The few of ``rows`` (with ``arrival_seq``) that decide each key's merged row; rows without a key all stay, once each.

    They are rows as they came, so merging them equals merging all, whatever is added
    later, earlier or again. A key keeps one row for each condition at most.
    """
    key, first, last = DECIDING[table]
    whole = F.struct("arrival_seq", *[c for c in rows.columns if c != "arrival_seq"])
    picks = [F.min(F.when(F.expr(c), whole)) for c in first] + [F.max(F.when(F.expr(c), whole)) for c in last]
    own = F.when(F.col(key).isNull(), F.xxhash64(F.to_json(whole)))
    kept = rows.withColumn(OWN, own).groupBy(key, OWN).agg(F.array_distinct(F.array_compact(F.array(*picks))).alias("rows_kept"))
    return kept.select(F.inline("rows_kept")).select(rows.columns)
