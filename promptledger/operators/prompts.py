"""One wide row per prompt, from the merged tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import basename, or_default, tool_label, usd, wall_seconds
from . import attribution, pricing

MAX_TEXT = 400
TOP_FILES = 40
COMPONENTS = ("c_read", "c_write", "c_out", "c_in")
NO_TEXT = "(prompt text unavailable)"


@dataclass
class Ledger:
    """The merged tables and what follows from them; every fact is grouped by target before any join.

    ``prompts`` may be a function that makes them, called when they are first needed.
    """

    prompts: DataFrame | Callable[[], DataFrame]
    requests: DataFrame
    tool_calls: DataFrame
    edits: DataFrame
    sessions: DataFrame
    rates: DataFrame
    promos: DataFrame

    def stored(self, written: Callable[[DataFrame, str], DataFrame], *names: str) -> Ledger:
        """The same ledger over tables that ``written`` has made of the merged ones and of the folded facts
        (all, or those of ``names``): whatever is asked of it then reads these and merges nothing again."""
        out = replace(self, prompts=self.__dict__["_prompts"])  # not made unless it is asked for
        for name in names or ("prompts", "requests", "sessions", "costed", "tools", "changes"):
            rows = written(getattr(out, name), name)
            if name in ("prompts", "requests", "sessions"):
                setattr(out, name, rows)
            else:
                out.__dict__[name] = rows  # in place of the cached property's own
        return out

    def only(self, targets: DataFrame) -> Ledger:
        """The ledger of the prompts ``targets(target)`` alone: their facts are picked before anything is grouped."""
        out = replace(self, prompts=self.prompts.join(targets.select(F.col("target").alias("prompt_id")), "prompt_id", "left_semi"))
        for name in ("costed", "tools", "changes"):
            out.__dict__[name] = getattr(self, name).join(targets, "target", "left_semi")
        return out

    def of_prompts(self, targets: DataFrame) -> Ledger:
        """As ``only``, for known prompts: their requests, calls and edits are picked by prompt id, before they are priced or folded."""
        ids = self.targets.join(targets, "target", "left_semi").select("prompt_id")
        pick = lambda rows: rows.join(ids, "prompt_id", "left_semi")
        return replace(self, prompts=pick(self.prompts), requests=pick(self.requests), tool_calls=pick(self.tool_calls), edits=pick(self.edits))

    @cached_property
    def targets(self) -> DataFrame:
        return attribution.targets(self.prompts)

    @cached_property
    def costed(self) -> DataFrame:
        """Requests with their price, cost and target."""
        return attribution.fold(pricing.costed(self.requests, self.rates, self.promos), self.targets)

    @cached_property
    def tools(self) -> DataFrame:
        return attribution.fold(self.tool_calls, self.targets)

    @cached_property
    def changes(self) -> DataFrame:
        return attribution.fold(self.edits, self.targets)

    @cached_property
    def session_projects(self) -> DataFrame:
        """``session_id, display``: the working directory's last part, else the project."""
        name = F.nullif(basename(F.col("cwd")), F.lit(""))
        return self.sessions.select("session_id", F.coalesce(name, "project").alias("display"), "project", "arrival_seq")

    @cached_property
    def project_names(self) -> DataFrame:
        """``project, name``: the display of the project's session that arrived last."""
        known = self.session_projects.where("coalesce(project, '') <> '' and coalesce(display, '') <> ''")
        return known.groupBy("project").agg(F.max_by("display", F.struct("arrival_seq", "session_id")).alias("name"))

    def prompt_models(self) -> DataFrame:
        """Tokens, cost and calls by target and model."""
        n = lambda c: F.sum(F.coalesce(c, F.lit(0)))
        return self.costed.groupBy("target", "model").agg(
            n("input_tokens").alias("in_tokens"), n("output_tokens").alias("out_tokens"), n("cache_read_tokens").alias("cr"),
            n("cache_create_tokens").alias("cw"), F.sum("micro_usd").cast("decimal(24,6)").alias("micro_usd"), F.count("*").alias("calls"),
        )

    def prompt_totals(self) -> DataFrame:
        n = lambda c: F.coalesce(c, F.lit(0))
        agent = F.coalesce("agent_name", F.lit("")) != ""
        return self.costed.groupBy("target").agg(
            F.count("*").alias("api_calls"), F.sum("micro_usd").cast("decimal(24,6)").alias("micro_usd"), F.bool_or("est").alias("est"),
            *[F.sum(c).cast("decimal(24,6)").alias(c) for c in COMPONENTS], F.sum("alt_micro").cast("decimal(24,6)").alias("alt_micro"),
            F.sum(n("output_tokens")).alias("out_tokens"), F.sum(n("input_tokens") + n("cache_read_tokens") + n("cache_create_tokens")).alias("inp"),
            F.sum(n("cache_read_tokens")).alias("cr"), F.sum(F.when(agent, n("output_tokens")).otherwise(0)).alias("agent_out"),
            F.max("ts").alias("last_request"), F.min("ts").alias("first_request"),
        )

    def request_projects(self) -> DataFrame:
        """``target, request_project``: of the earliest request whose session is known."""
        shown = self.costed.select("target", "session_id", "ts", "request_id").join(self.session_projects.select("session_id", "display"), "session_id")
        first = F.struct(F.coalesce("ts", F.lit("9999-12-31").cast("timestamp_ntz")), F.coalesce("request_id", F.lit("")))
        return shown.where("coalesce(display, '') <> ''").groupBy("target").agg(F.min_by("display", first).alias("request_project"))

    def tool_histogram(self) -> DataFrame:
        return self.tools.groupBy("target", tool_label(F.col("tool_name"), F.col("detail")).alias("label")).agg(F.count("*").alias("n"))

    def agents(self) -> DataFrame:
        """Distinct ``target, agent`` over requests, calls and edits."""
        parts = [x.select("target", F.col("agent_name").alias("agent")) for x in (self.costed, self.tools, self.changes) if "agent_name" in x.columns]
        both = parts[0]
        for x in parts[1:]:
            both = both.unionByName(x)
        return both.where("coalesce(agent, '') <> ''").distinct()

    def prompt_files(self) -> DataFrame:
        """Lines and characters by target and path."""
        n = lambda c: F.sum(F.coalesce(c, F.lit(0)))
        return self.changes.groupBy("target", or_default(F.col("file_path"), "?").alias("path")).agg(
            n("lines_added").alias("added"), n("lines_removed").alias("removed"), n("chars_added").alias("chars")
        )

    def file_stats(self) -> DataFrame:
        return self.prompt_files().groupBy("target").agg(F.count("*").alias("files"), F.sum("added").alias("ladd"), F.sum("removed").alias("lrem"), F.sum("chars").alias("chars"))

    def top_files(self, most: int = TOP_FILES) -> DataFrame:
        w = Window.partitionBy("target").orderBy(F.desc(F.col("added") + F.col("removed")), "path")
        return self.prompt_files().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)

    def unpriced(self) -> DataFrame:
        """Models without a rate that used tokens: rows, uncosted rows, tokens."""
        n = lambda c: F.coalesce(c, F.lit(0))
        tokens = n("input_tokens") + n("output_tokens") + n("cache_read_tokens") + n("cache_create_tokens")
        rows = self.costed.where("price_in is null").groupBy("model").agg(F.count("*").alias("n_rows"), F.sum(F.col("est").cast("int")).alias("uncosted"), F.sum(tokens).alias("tokens"))
        return rows.where("tokens > 0").orderBy(F.desc("tokens"), "model")

    @property
    def own(self) -> DataFrame:
        """The prompts that no other one stands for."""
        return self.prompts.where(F.col("prompt_id").isNotNull() & (~attribution.folds() | (F.col("canonical_id") == F.col("prompt_id"))))

    def texts(self) -> DataFrame:
        """``target, text`` of every known prompt, as its wide row would show it."""
        return self.own.select(F.col("prompt_id").alias("target"), _shown().alias("text"))

    def usage(self) -> DataFrame:
        """The wide rows without their lists: prompts with a request or a call, and placeholders for unknown ones."""
        tools = self.tool_histogram().groupBy("target").agg(F.sum("n").alias("tool_calls"))
        facts = self.prompt_totals().join(tools, "target", "full_outer").join(self.file_stats(), "target", "full_outer")
        rows = self.own.select(F.col("prompt_id").alias("target"), "session_id", "project", F.col("ts").alias("prompt_ts"), "text", F.lit(True).alias("known")).join(facts, "target", "full_outer")
        rows = rows.where("coalesce(api_calls, 0) > 0 or coalesce(tool_calls, 0) > 0")
        shown = self.session_projects.select("session_id", F.col("display").alias("session_display"))
        rows = rows.join(shown, "session_id", "left").join(self.request_projects(), "target", "left")
        first = F.coalesce(F.nullif("project", F.lit("")), F.nullif("session_display", F.lit("")), "request_project", F.lit("?"))
        rows = rows.withColumn("slug", first).join(self.project_names.select(F.col("project").alias("slug"), "name"), "slug", "left")
        ts = F.coalesce("prompt_ts", "first_request")
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return rows.select(
            F.col("target").alias("id"), ts.alias("ts"), F.coalesce("name", F.when(F.col("session_display").isNotNull(), F.col("session_display")), "slug").alias("project"),
            F.when(F.col("known"), _shown()).otherwise(NO_TEXT).alias("text"),
            zero("api_calls"), zero("tool_calls"), usd(F.coalesce("micro_usd", F.lit(0))).alias("cost"), F.coalesce("est", F.lit(False)).alias("est"),
            wall_seconds(ts, F.greatest(ts, "last_request")).alias("wall_s"), zero("out_tokens"), zero("inp"), zero("cr"), zero("agent_out"),
            zero("files"), zero("ladd"), zero("lrem"), zero("chars"), *[usd(F.coalesce(c, F.lit(0))).alias(c) for c in COMPONENTS],
            usd(F.coalesce("alt_micro", F.lit(0))).alias("alt"),
        )

    def usage_with_lists(self) -> DataFrame:
        """``usage`` with models, tools, agents and file_list, each gathered from grouped rows."""
        m = self.prompt_models().withColumn("m", F.struct((-F.col("out_tokens")).alias("o"), "model", "in_tokens", "out_tokens", "cr", "cw", usd(F.col("micro_usd")).alias("cost"), "calls"))
        models = m.groupBy("target").agg(F.transform(F.array_sort(F.collect_list("m")), lambda x: x.dropFields("o")).alias("models"))
        t = self.tool_histogram().withColumn("t", F.struct((-F.col("n")).alias("o"), F.col("label").alias("name"), "n"))
        tools = t.groupBy("target").agg(F.transform(F.array_sort(F.collect_list("t")), lambda x: x.dropFields("o")).alias("tools"))
        agents = self.agents().groupBy("target").agg(F.array_sort(F.collect_list("agent")).alias("agents"))
        f = self.top_files().groupBy("target").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "added", "removed"))).alias("f"))
        files = f.select("target", F.transform("f", lambda x: x.dropFields("rank")).alias("file_list"))
        rows = self.usage().withColumnRenamed("id", "target")
        for side in (models, tools, agents, files):
            rows = rows.join(side, "target", "left")
        return rows.withColumnRenamed("target", "id")


def _shown() -> Column:
    return F.substring(F.coalesce("text", F.lit("")), 1, MAX_TEXT)


def _prompts(ledger: Ledger) -> DataFrame:
    made = ledger.__dict__["_prompts"]
    if callable(made):
        made = ledger.__dict__["_prompts"] = made()
    return made


Ledger.prompts = property(_prompts, lambda ledger, made: ledger.__dict__.__setitem__("_prompts", made))
