"""Scalar functions, all Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = "decimal(24,6)"

#: Starts of texts that the harness injects.
INJECTED_PREFIXES = ("<task-notification>", "<teammate-message", "<system-reminder>", "<command-name>", "Caveat: The messages below")
#: Substrings of model names and their family, in this order.
FAMILIES = (("opus", "opus"), ("fable", "fable"), ("mythos", "fable"), ("sonnet", "sonnet"), ("haiku", "haiku"))


def or_default(x: Column, default: str) -> Column:
    """``default`` for null or empty text."""
    return F.when(x.isNull() | (x == ""), F.lit(default)).otherwise(x)


def parse_ts(text: Column) -> Column:
    """ISO-8601 text to TIMESTAMP_NTZ in UTC; null if it cannot be read."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(zoned).cast("timestamp_ntz"))


def is_injected(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"^\s+", "")
    found = F.lit(False)
    for p in INJECTED_PREFIXES:
        found = found | trimmed.startswith(p)
    return F.coalesce(found, F.lit(False))


def normal_model(model: Column) -> Column:
    return F.trim(F.split_part(model, F.lit("["), F.lit(1)))


def model_family(model: Column) -> Column:
    family = F.lit("other")
    for part, name in reversed(FAMILIES):
        family = F.when(model.contains(part), F.lit(name)).otherwise(family)
    return family


def basename(path: Column) -> Column:
    """Last part of a path with either separator, trailing ones cut; empty for a null path."""
    return F.coalesce(F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1), F.lit(""))


def tool_label(name: Column, detail: Column) -> Column:
    return F.when((name == "Skill") & (F.coalesce(detail, F.lit("")) != ""), F.concat(F.lit("Skill:"), detail)).otherwise(or_default(name, "?"))


def floor_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def hour_number(ts: Column) -> Column:
    """Whole hours since 1970, without a time zone."""
    return F.timestamp_diff("HOUR", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def hour_start(number: Column) -> Column:
    return F.timestamp_add("HOUR", number.cast("int"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def iso_week(day: Column) -> Column:
    """``YYYY-Www``."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))


def wall_seconds(first: Column, last: Column) -> Column:
    """Seconds between, halves to even; null if unknown or negative."""
    span = F.timestamp_diff("MICROSECOND", first, last)
    return F.when(span >= 0, F.bround(span.cast("decimal(20,0)") * F.lit(0.000001).cast("decimal(7,6)"), 0).cast("long"))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def usd(micro: Column, places: int = 4) -> Column:
    """Micro-dollars (decimal) to dollars: rounded as decimal, double at last."""
    return F.round(micro.cast(MICRO) * F.lit("0.000001").cast("decimal(7,6)"), places).cast("double")


def human_number(n: Column) -> Column:
    """1.2B, 3.4M, 56.7K from ten thousand on, else with thousands separators; a dash for null."""
    d = n.cast("decimal(30,6)")
    a = F.abs(d)
    short = lambda factor, unit: F.concat(F.round(d * F.lit(factor).cast("decimal(12,9)"), 1).cast("decimal(30,1)").cast("string"), F.lit(unit))
    return (
        F.when(d.isNull(), F.lit("–")).when(a >= 1_000_000_000, short("0.000000001", "B")).when(a >= 1_000_000, short("0.000001", "M"))
        .when(a >= 10_000, short("0.001", "K")).otherwise(F.format_number(F.round(d, 0).cast("long"), 0))
    )


def cost_label(cost: Column, estimated: Column) -> Column:
    d = F.round(cost.cast("decimal(20,4)"), 2)
    sign = F.when(estimated, F.lit("~$")).otherwise(F.lit("$"))
    return F.concat(sign, F.when(cost >= 100, F.round(cost.cast("decimal(20,4)"), 0).cast("decimal(20,0)").cast("string")).otherwise(d.cast("decimal(20,2)").cast("string")))


def patch_stats(lines: Column) -> Column:
    """Struct (added, removed, chars) of diff lines: chars counts added lines without their sign."""
    plus = F.filter(lines, lambda x: x.startswith("+"))
    minus = F.filter(lines, lambda x: x.startswith("-"))
    chars = F.aggregate(plus, F.lit(0).cast("long"), lambda a, x: a + F.length(x) - 1)
    return F.struct(F.size(plus).cast("long").alias("added"), F.size(minus).cast("long").alias("removed"), chars.alias("chars"))


def created_stats(content: Column) -> Column:
    """Struct (added, removed, chars) of a created file: line feeds and one, nothing for an empty one."""
    text = F.coalesce(content, F.lit(""))
    added = F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return F.struct(added.alias("added"), F.lit(0).cast("long").alias("removed"), F.length(text).cast("long").alias("chars"))
