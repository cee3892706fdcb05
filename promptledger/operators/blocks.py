"""Chained five-hour usage blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hour_number, hour_start, usd

BLOCK_HOURS = 5
LOOKBACK_HOURS = 36


def hourly(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Partials by key and hour: all that the chain needs, 8,760 rows a key and year at most."""
    hour = hour_number(F.col("ts")).alias("hour")
    return requests.where("ts is not null").groupBy(*keys, hour).agg(
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("out_tokens"), F.sum("micro_usd").alias("micro_usd"), F.count("*").alias("requests"), F.max("ts").alias("last_ts")
    )


def _starts(per_hour: DataFrame, keys: list[str], span: int) -> DataFrame:
    """``per_hour`` with ``start``, the block's first hour: one pass over each key's hours in order.

    Only the last start is held, so time and memory are linear; a key has no more hours
    than its calendar, so even one key for all is some thousand rows a year in its task.
    """
    columns = [*keys, "hour", *[c for c in per_hour.columns if c not in (*keys, "hour")]]
    kinds = dict(per_hour.dtypes)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = start = None
        for batch in batches:
            names = [batch.column(k).to_pylist() for k in keys]
            out = []
            for h, *own in zip(batch.column("hour").to_pylist(), *names):
                if own != key or h >= start + span:
                    key, start = own, h
                out.append(start)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*columns, "start"])

    dealt = per_hour.select(columns).repartition(*keys) if keys else per_hour.select(columns).coalesce(1)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", start bigint"
    return dealt.sortWithinPartitions(*keys, "hour").mapInArrow(chain, schema)


def chained(per_hour: DataFrame, keys: list[str], span: int = BLOCK_HOURS) -> DataFrame:
    """Blocks of each key from its hours: a block starts at the first hour at or after the end of the one before."""
    folded = _starts(per_hour, keys, span).groupBy(*keys, "start").agg(F.sum("out_tokens").alias("out_tokens"), usd(F.sum("micro_usd")).alias("cost"), F.sum("requests").alias("requests"))
    return folded.select(*keys, hour_start(F.col("start")).alias("block_start"), hour_start(F.col("start") + span).alias("block_end"), "out_tokens", "cost", "requests")


def blocks(requests: DataFrame, keys: list[str] | None = None, span: int = BLOCK_HOURS) -> DataFrame:
    """Blocks of each key: block_start, block_end, out_tokens, cost, requests.

    A block starts at the floored hour of the first request at or after the end
    of the one before, so only the hours are chained, never requests.
    """
    return chained(hourly(requests, keys or []), keys or [], span)


def current(found: DataFrame, now: Column) -> DataFrame:
    """The last block if ``now`` is before its end, else no row."""
    return found.orderBy(F.desc("block_start")).limit(1).where(now < F.col("block_end"))


def current_block(requests: DataFrame, now: Column, span: int = BLOCK_HOURS, lookback: int = LOOKBACK_HOURS) -> DataFrame:
    """The current block; requests of the last 36 hours seed the chain."""
    recent = requests.where(F.col("ts") >= F.timestamp_add("HOUR", F.lit(-lookback), now))
    return current(blocks(recent, span=span), now)
