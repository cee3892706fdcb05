"""Digests, day series and subtotals over the wide prompt rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import model_family, truncated, usd

DIGEST_DAYS = 7
TOP_PROMPTS = 10
TOP_TEXT = 90
#: Days under a minute of activity, or under 50 lines, give no rate.
LEAST_SECONDS, LEAST_LINES = 60, 50


def ratio(a: Column, b: Column, places: int = 6) -> Column:
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), places)


def dollars(cost: str = "cost") -> Column:
    """Sum of dollars that are already rounded to 4 places: exact as decimals."""
    return F.sum(F.col(cost).cast("decimal(20,4)")).cast("double")


def trailing_days(rows: DataFrame, now: Column, days: int = DIGEST_DAYS) -> DataFrame:
    """Prompts of the last full UTC days before the midnight of ``now``: half-open, ts known."""
    end = F.date_trunc("day", now).cast("timestamp_ntz")
    return rows.where((F.col("ts") >= F.timestamp_add("DAY", F.lit(-days), end)) & (F.col("ts") < end))


def digest_totals(rows: DataFrame, agents: DataFrame) -> DataFrame:
    """One row; ``agents(target)`` has a row for each distinct agent of a prompt."""
    per = rows.join(agents.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n_agents")), "id", "left")
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return per.agg(
        F.count("*").alias("prompts"), s("out_tokens"), s("inp"), F.coalesce(dollars(), F.lit(0.0)).alias("cost"), F.coalesce(F.bool_or("est"), F.lit(False)).alias("est"),
        s("ladd"), s("lrem"), s("files"), F.coalesce(F.sum("n_agents"), F.lit(0)).alias("agents"),
    )


def by_project(rows: DataFrame) -> DataFrame:
    lines = F.sum(F.col("ladd") + F.col("lrem")).alias("n_lines")
    return rows.groupBy("project").agg(F.count("*").alias("prompts"), F.sum("inp").alias("inp"), F.sum("out_tokens").alias("out_tokens"), lines, dollars().alias("cost")).orderBy(F.desc("cost"), "project")


def by_family(models: DataFrame) -> DataFrame:
    """From the (target, model) rows of the wanted prompts; costs are not rounded before they are summed."""
    family = model_family(F.col("model")).alias("family")
    return models.groupBy(family).agg(F.sum("calls").alias("calls"), F.sum("out_tokens").alias("out_tokens"), usd(F.sum("micro_usd")).alias("cost")).orderBy(F.desc("cost"), "family")


def day() -> Column:
    """Day key: the first ten characters of the time."""
    return F.date_format("ts", "yyyy-MM-dd").alias("day")


def by_day(rows: DataFrame) -> DataFrame:
    return rows.groupBy(day()).agg(F.count("*").alias("prompts"), F.sum("out_tokens").alias("out_tokens"), dollars().alias("cost")).orderBy("day")


def top_prompts(rows: DataFrame, most: int = TOP_PROMPTS) -> DataFrame:
    """The most expensive prompts, text cut for display."""
    best = rows.orderBy(F.desc("cost"), "id").limit(most)
    return best.select("id", day(), "project", truncated(F.col("text"), TOP_TEXT).alias("text"), "out_tokens", "cost")


def project_subtotals(rows: DataFrame) -> DataFrame:
    """A row for each prompt, one for each project and a grand total; rates are ratios of sums."""
    return rows.rollup("project", "id").agg(
        F.grouping_id().alias("level"), F.count("*").alias("prompts"), F.sum("out_tokens").alias("out_tokens"), dollars().alias("cost"),
        ratio(F.sum("cr"), F.sum("inp")).alias("hit_rate"),
    )


def daily(rows: DataFrame, *columns: Column) -> DataFrame:
    return rows.where("ts is not null").groupBy(day()).agg(*columns)


def daily_output(rows: DataFrame) -> DataFrame:
    return daily(rows, F.sum("out_tokens").alias("out_tokens"))


def daily_per_minute(rows: DataFrame, column: str, name: str) -> DataFrame:
    seconds = daily(rows, F.sum("wall_s").alias("seconds"), F.sum(column).alias("total")).where(F.col("seconds") >= LEAST_SECONDS)
    return seconds.select("day", ratio(F.col("total") * 60, F.col("seconds")).alias(name))


def daily_cost(rows: DataFrame) -> DataFrame:
    return daily(rows, dollars().alias("cost"), dollars("alt").alias("alt"))


def daily_composition(rows: DataFrame) -> DataFrame:
    return daily(rows, *[dollars(c).alias(c) for c in ("c_read", "c_write", "c_out", "c_in")])


def daily_cache_hit(rows: DataFrame) -> DataFrame:
    return daily(rows, ratio(F.sum("cr"), F.sum("inp")).alias("hit_rate"))


def daily_cost_per_kloc(rows: DataFrame) -> DataFrame:
    sums = daily(rows, F.sum("ladd").alias("n_lines"), dollars().alias("cost")).where(F.col("n_lines") >= LEAST_LINES)
    return sums.select("day", ratio(F.col("cost") * 1000, F.col("n_lines")).alias("cost_per_kloc"))


def daily_model_mix(rows: DataFrame, models: DataFrame) -> DataFrame:
    dated = models.join(rows.where("ts is not null").select(F.col("id").alias("target"), day()), "target")
    return dated.groupBy("day", model_family(F.col("model")).alias("family")).agg(F.sum("out_tokens").alias("out_tokens"))


def daily_subagent_share(rows: DataFrame) -> DataFrame:
    return daily(rows, ratio(F.sum("agent_out"), F.sum("out_tokens")).alias("agent_share"))


def prompt_rates(rows: DataFrame) -> DataFrame:
    return rows.select(
        "id", ratio(F.col("out_tokens") * 60, F.nullif("wall_s", F.lit(0))).alias("tokens_per_min"), ratio(F.col("ladd") * 60, F.nullif("wall_s", F.lit(0))).alias("lines_per_min"),
        ratio(F.col("cr"), F.nullif("inp", F.lit(0))).alias("hit_rate"), ratio(F.col("cost") * 1000, F.nullif("ladd", F.lit(0))).alias("cost_per_kloc"),
        ratio(F.col("agent_out"), F.nullif("out_tokens", F.lit(0))).alias("agent_share"),
    )


def filtered(rows: DataFrame, project: str | None = None, text: str | None = None, first: str | None = None, before: str | None = None, families: DataFrame | None = None) -> DataFrame:
    """The interactive filters; ``families(id)`` has the prompts that used a wanted model family."""
    if project is not None:
        rows = rows.where(F.col("project") == project)
    if text is not None:
        rows = rows.where(F.contains(F.lower("text"), F.lit(text.lower())))
    if first is not None:
        rows = rows.where(F.col("ts") >= F.lit(first).cast("timestamp_ntz"))
    if before is not None:
        rows = rows.where(F.col("ts") < F.lit(before).cast("timestamp_ntz"))
    return rows if families is None else rows.join(families.select("id").distinct(), "id", "left_semi")
