"""Session transcripts (JSON lines) as rows, and the facts in them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import created_stats, or_default, parse_ts, patch_stats
from ..operators.attribution import file_first, forward_fill
from . import storage


#: Numbers of file blocks are broadcast up to this many, else joined by shuffle.
BROADCAST_BLOCKS = 1_000_000
_GLOB = r"([\[\]{}*?\\])"


def file_path() -> Column:
    """The path of a row's file, as it is named in its folder."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def scan(spark: SparkSession, root: str | list[str], pattern: str = "*.jsonl") -> DataFrame:
    """path, line_no, entry (VARIANT) of every JSON object line of the files below ``root`` (or of a list of files).

    Blank, malformed and non-object lines are skipped but counted. How files are cut into
    tasks depends on the executors of the moment, so one job alone reads them: it writes
    each line with its block's start and its place within the task. Numbers follow from
    what was written (the counts of a file's earlier blocks, and the place), whatever the
    executors are when it is read; no line is shuffled and a large file is many tasks.
    """
    named = [re.sub(_GLOB, r"\\\1", x) for x in root] if isinstance(root, list) else root
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(named)
    parsed = F.try_parse_json("value")
    entry = F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed).alias("entry")
    lines = storage.written(raw.select(file_path().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("within"), entry), "lines")
    blocks = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("within").alias("first"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = storage.written(blocks.select("path", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift")), "blocks")
    if blocks.count() <= BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    return lines.where("entry is not null").join(blocks, ["path", "block"]).select("path", (F.col("within") + F.col("shift") + 1).alias("line_no"), "entry")


def path_identity(path: Column) -> dict[str, Column]:
    """project, session_id, agent_name and is_subagent from a transcript's path."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    sub = path.contains("/subagents/")
    return {
        "is_subagent": sub,
        "project": F.when(sub, F.get(parts, F.size(parts) - 4)).otherwise(F.get(parts, F.size(parts) - 2)),
        "session_id": F.when(sub, F.get(parts, F.size(parts) - 3)).otherwise(stem),
        "agent_name": F.when(sub, stem),
    }


def _get(path: str, kind: str = "string", entry: str = "entry") -> Column:
    return F.try_variant_get(F.col(entry), F.lit(path), kind)


def is_human_prompt() -> Column:
    meta = F.coalesce(_get("$.isMeta", "boolean"), F.lit(False))
    return F.coalesce((_get("$.type") == "user") & ~meta & (_get("$.origin.kind") == "human"), F.lit(False))


def blocks() -> Column:
    return F.coalesce(_get("$.message.content", "array<variant>"), F.array().cast("array<variant>"))


def prompt_text() -> Column:
    """String content as it is; a list's text blocks joined by one space; else empty."""
    texts = F.filter(F.transform(blocks(), lambda b: F.when(F.try_variant_get(b, F.lit("$.type"), "string") == "text", F.coalesce(F.try_variant_get(b, F.lit("$.text"), "string"), F.lit("")))), lambda t: t.isNotNull())
    listed = _get("$.message.content", "array<variant>").isNotNull()
    said = F.schema_of_variant(_get("$.message.content", "variant")) == "STRING"
    return F.when(listed, F.array_join(texts, " ")).when(said, _get("$.message.content")).otherwise("")


def attributed(entries: DataFrame) -> DataFrame:
    """path, line_no and prompt_id of every entry that belongs to a prompt.

    Main files: the last human prompt at or above. Subagent files: an entry's own id,
    else the file's first. Only these few columns are sorted by file, never entries.
    """
    sub = path_identity(F.col("path"))["is_subagent"]
    keys = entries.select("path", "line_no", sub.alias("is_subagent"), (is_human_prompt() & ~sub).alias("is_prompt"), _get("$.promptId").alias("own_prompt"))
    main = forward_fill(keys.where(~F.col("is_subagent")), "path", "line_no", "is_prompt", "own_prompt").select("path", "line_no", "prompt_id")
    return main.where("prompt_id is not null").unionByName(file_first(keys.where("is_subagent"), "path", "line_no", "own_prompt").select("path", "line_no", "prompt_id"))


def _with_prompt(facts: DataFrame, owned: DataFrame) -> DataFrame:
    """Facts of entries that belong to a prompt, with the identity of their file; entries themselves are not shuffled."""
    ids = path_identity(F.col("path"))
    return facts.join(owned, ["path", "line_no"]).withColumns({c: ids[c] for c in ("session_id", "project", "agent_name", "is_subagent")})


def _time() -> Column:
    return parse_ts(_get("$.timestamp")).alias("ts")


def prompts(entries: DataFrame) -> DataFrame:
    """Human prompts of main files that have an id."""
    ids = path_identity(F.col("path"))
    rows = entries.where(is_human_prompt() & ~ids["is_subagent"]).select(_get("$.promptId").alias("prompt_id"), ids["session_id"].alias("session_id"), ids["project"].alias("project"), _time(), prompt_text().alias("text"), "path", "line_no")
    return rows.where("coalesce(prompt_id, '') <> ''").select("prompt_id", "session_id", "project", "ts", "text", F.lit("jsonl").alias("source"), F.lit(0).alias("injected"), "path", "line_no")


def requests(entries: DataFrame, owned: DataFrame) -> DataFrame:
    """Assistant entries with usage and a request id; missing token counts are 0, cost is unknown."""
    usage = _get("$.message.usage", "map<string, variant>")
    n = lambda path, name: F.coalesce(_get(f"$.message.usage.{path}", "bigint"), F.lit(0).cast("bigint")).alias(name)
    known = entries.where((_get("$.type") == "assistant") & (F.coalesce(_get("$.requestId"), F.lit("")) != "") & (F.size(usage) > 0)).select(
        _get("$.requestId").alias("request_id"), _time(), or_default(_get("$.message.model"), "?").alias("model"),
        n("input_tokens", "input_tokens"), n("output_tokens", "output_tokens"), n("cache_read_input_tokens", "cache_read_tokens"), n("cache_creation_input_tokens", "cache_create_tokens"),
        n("cache_creation.ephemeral_5m_input_tokens", "cache_5m_tokens"), n("cache_creation.ephemeral_1h_input_tokens", "cache_1h_tokens"), "path", "line_no",
    )
    return _with_prompt(known, owned).select(
        "request_id", "prompt_id", "session_id", "ts", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_create_tokens", "cache_5m_tokens", "cache_1h_tokens",
        F.lit(None).cast("double").alias("cost_usd"), F.lit(None).cast("bigint").alias("duration_ms"), F.when(F.col("is_subagent"), "subagent").otherwise("main").alias("query_source"),
        "agent_name", F.lit("jsonl").alias("source"), "path", "line_no",
    )


def tool_calls(entries: DataFrame, owned: DataFrame) -> DataFrame:
    each = entries.where(_get("$.type") == "assistant").select(_time(), "path", "line_no", F.explode(blocks()).alias("b"))
    b = lambda path: _get(path, entry="b")
    name = or_default(b("$.name"), "?")
    calls = each.where((b("$.type") == "tool_use") & (F.coalesce(b("$.id"), F.lit("")) != ""))
    calls = calls.select(b("$.id").alias("tool_use_id"), "ts", name.alias("tool_name"), F.when(name == "Skill", b("$.input.skill")).alias("detail"), "path", "line_no")
    return _with_prompt(calls, owned).select("tool_use_id", "prompt_id", "session_id", "ts", "tool_name", "agent_name", F.lit("jsonl").alias("source"), "detail", "path", "line_no")


def edits(entries: DataFrame, owned: DataFrame) -> DataFrame:
    """File changes that tool results report: a path, and a type or the key of a patch (its value may be null)."""
    result = _get("$.toolUseResult", "map<string, variant>")
    kind = _get("$.toolUseResult.type")
    kind = F.when(kind.isin("create", "update"), kind).when(F.array_contains(F.map_keys(result), "structuredPatch"), "update")
    first = F.get(F.filter(blocks(), lambda x: F.try_variant_get(x, F.lit("$.type"), "string") == "tool_result"), 0)
    hunks = F.coalesce(_get("$.toolUseResult.structuredPatch", "array<variant>"), F.array().cast("array<variant>"))
    lines = F.flatten(F.transform(hunks, lambda h: F.coalesce(F.try_variant_get(h, F.lit("$.lines"), "array<string>"), F.array().cast("array<string>"))))
    content = F.coalesce(_get("$.toolUseResult.content"), F.lit(""))
    stats = F.when((F.col("kind") == "create") & (F.size(hunks) == 0), created_stats(content)).otherwise(patch_stats(lines))
    sub = path_identity(F.col("path"))["is_subagent"]
    users = entries.where((_get("$.type") == "user") & (~is_human_prompt() | sub))
    named = users.withColumns({"kind": kind, "file_path": _get("$.toolUseResult.filePath"), "tool_use_id": F.try_variant_get(first, F.lit("$.tool_use_id"), "string")})
    kept = named.where("kind is not null and coalesce(file_path, '') <> '' and coalesce(tool_use_id, '') <> ''").withColumn("s", stats)
    kept = kept.select("tool_use_id", _time(), "file_path", "kind", F.col("s.added").alias("lines_added"), F.col("s.removed").alias("lines_removed"), F.col("s.chars").alias("chars_added"), "path", "line_no")
    return _with_prompt(kept, owned).select(
        "tool_use_id", "prompt_id", "session_id", "ts", "file_path", "kind", "lines_added", "lines_removed", "chars_added", "agent_name", F.lit("jsonl").alias("source"), "path", "line_no"
    )


def sessions(entries: DataFrame) -> DataFrame:
    """A row for each main file, with its first working directory and the place of that or of its first entry."""
    rows = entries.withColumns(path_identity(F.col("path"))).where(~F.col("is_subagent"))
    cwd = F.nullif(_get("$.cwd"), F.lit(""))
    return rows.select("session_id", "project", cwd.alias("cwd"), "path", "line_no").groupBy("session_id", "project", "path").agg(
        F.min(F.when(F.col("cwd").isNotNull(), F.struct("line_no", "cwd")))["cwd"].alias("cwd"), F.min("line_no").alias("line_no")
    )
