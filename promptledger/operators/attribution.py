"""Which prompt an entry, request, call or edit belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import storage


#: Groups with more rows are scanned in pieces, each a task of its own.
HELD_ROWS = 200_000


def running_last(rows: DataFrame, group: str, order: list[str], mark: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the last not-null ``mark`` (of rows as they are) of a group at or above each row; null where ``group`` is null.

    Groups of HELD_ROWS rows at most are one window each. A larger one is a scan in two
    levels: it is range-partitioned by its order and written, every piece is a window of
    its own, and the last mark of the pieces before it is carried in. A range partition
    bounds two groups' pieces at most on either side, so what is carried is fewer than two
    rows a partition, which are broadcast. Equal rows in ``order`` may be in either order.
    """
    spark = rows.sparkSession
    marked = storage.written(rows.withColumn(name, mark), "marks")
    sizes = marked.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > HELD_ROWS).select(group)
    hot = storage.written(sizes, "hot-groups")
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda over: F.last(name, ignorenulls=True).over(over)
    if hot.isEmpty():
        held, wide = marked.where(F.col(group).isNotNull()), None
    else:
        # groups of more than HELD_ROWS rows: as many as rows / HELD_ROWS at most
        held, wide = marked.where(F.col(group).isNotNull()).join(hot, group, "left_anti"), marked.join(hot, group, "left_semi")
    out = held.withColumn(name, last(w)).unionByName(marked.where(F.col(group).isNull()).withColumn(name, F.lit(None).cast(marked.schema[name].dataType)))
    if wide is None:
        return out
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    piece = free_name("_piece", rows)
    pieces = storage.written(wide.repartitionByRange(n, group, *order).withColumn(piece, F.spark_partition_id()), "pieces")
    within = Window.partitionBy(piece, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = pieces.withColumn(name, last(within))
    ends = pieces.where(F.col(name).isNotNull()).groupBy(group, piece).agg(F.max_by(name, F.struct(*[_rank(c) for c in order])).alias("end"))
    starts = pieces.select(group, piece).distinct().join(ends, [group, piece], "left")
    earlier = Window.partitionBy(group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    carried = starts.select(group, piece, F.last("end", ignorenulls=True).over(earlier).alias("carried")).where("carried is not null")
    return out.unionByName(local.join(F.broadcast(carried), [group, piece], "left").withColumn(name, F.coalesce(name, "carried")).select(out.columns))


def _rank(column: str) -> Column:
    """A value that sorts as the column does, nulls first."""
    return F.struct(F.col(column).isNotNull(), F.col(column))


def free_name(wanted: str, frame: DataFrame) -> str:
    while wanted in frame.columns:
        wanted = "_" + wanted
    return wanted


def asof_canonical(prompts: DataFrame) -> DataFrame:
    """Injected prompts with the latest typed prompt of their session at or before them.

    Prompts without a ts come first, so they are the last resort; an injected one without
    a ts finds only those. No session, no match. A session of very many prompts is
    scanned in pieces.
    """
    typed = F.when(F.col("injected") == 0, F.col("prompt_id"))
    last = running_last(prompts.drop("canonical_id"), "session_id", ["ts", "injected", "prompt_id"], typed, "canonical_id")
    found = last.withColumn("canonical_id", F.when(F.col("injected") == 1, F.col("canonical_id")))
    return found.select(*[c for c in prompts.columns if c != "canonical_id"], "canonical_id")


def folds() -> Column:
    """True for an injected prompt that a typed one stands for."""
    return F.coalesce((F.col("injected") == 1) & F.col("canonical_id").isNotNull(), F.lit(False))


def targets(prompts: DataFrame) -> DataFrame:
    """``prompt_id, target``: one hop from injected prompts to their canonical ones."""
    return prompts.where("prompt_id is not null").select("prompt_id", F.when(folds(), F.col("canonical_id")).otherwise(F.col("prompt_id")).alias("target"))


def fold(facts: DataFrame, target: DataFrame) -> DataFrame:
    """Facts of known prompts with ``target``; those of prompts never seen keep their own id."""
    moved = target.where("target <> prompt_id")  # only folded prompts need the join
    return facts.where("prompt_id is not null").join(moved, "prompt_id", "left").withColumn("target", F.coalesce("target", "prompt_id"))


def forward_fill(entries: DataFrame, file: str, line: str, is_prompt: str, prompt: str) -> DataFrame:
    """Add ``prompt_id``: that of the last prompt entry at or above each line of a file.

    A prompt entry without an id resets it to null. Only these columns are sorted; a file of
    very many lines is scanned in pieces.
    """
    mark = F.when(F.col(is_prompt), F.struct(F.col(prompt).alias("p")))
    return running_last(entries, file, [line], mark, "prompt_id").withColumn("prompt_id", F.nullif(F.col("prompt_id.p"), F.lit("")))


def file_first(entries: DataFrame, file: str, line: str, prompt: str) -> DataFrame:
    """Add ``prompt_id``: an entry's own, else the first of its file; files without any are dropped."""
    own = F.nullif(F.col(prompt), F.lit(""))
    first = entries.where(own.isNotNull()).groupBy(file).agg(F.min_by(prompt, line).alias("first_prompt"))
    return entries.join(first, file).withColumn("prompt_id", F.coalesce(own, "first_prompt")).drop("first_prompt")
