"""A trigram index over texts: which rows can contain a pattern, without reading the others.

Rows are written in blocks; a posting table, sorted by trigram, names block and
number of the rows that hold each trigram of the lower-case text, and a count of
rows for each trigram. A search reads the counts and postings of the pattern's
trigrams, then the blocks that hold a candidate, and compares the texts exactly.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Blocks of rows and folders of postings; a search brings block numbers, BLOCKS at most, to the driver.
BLOCKS = 256
BUCKETS = 16
#: Trigrams of a pattern that are looked up, the rarest; the exact comparison follows.
RAREST = 4
#: A pattern whose rarest trigram is in more than this share of the rows reads all rows.
SCAN_SHARE = 0.25
OWN = ("index_row", "index_block")


def trigrams(text: Column) -> Column:
    """Distinct hashed trigrams of a text; none for null and for less than three letters."""
    found = F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1))
    return F.coalesce(F.array_distinct(F.transform(found, lambda g: F.xxhash64(g))), F.array().cast("array<bigint>"))


def write_index(rows: DataFrame, path: str, column: str = "text", blocks: int = BLOCKS) -> None:
    """Write ``rows`` with an index of ``column`` to ``path``, a new folder.

    Repeated rows and null texts are rows like others. A trigram that most rows
    hold is dealt over tasks by row number.
    """
    if set(OWN) & {c.lower() for c in rows.columns}:
        raise ValueError(f"{OWN} are the index's own columns")
    spark = rows.sparkSession
    numbered = rows.withColumn("index_row", F.monotonically_increasing_id())
    numbered = numbered.withColumn("index_block", F.pmod(F.xxhash64("index_row"), F.lit(blocks)).cast("int"))
    numbered.repartition("index_block").write.partitionBy("index_block").parquet(f"{path}/rows")
    stored = spark.read.schema(numbered.schema).parquet(f"{path}/rows")
    grams = stored.select("index_row", "index_block", F.explode(trigrams(F.lower(column))).alias("gram"))
    grams = grams.withColumn("bucket", F.pmod("gram", F.lit(BUCKETS)).cast("int"))
    in_order = grams.repartitionByRange("bucket", "gram", "index_row").sortWithinPartitions("bucket", "gram", "index_row")
    in_order.write.partitionBy("bucket").parquet(f"{path}/postings")
    postings = spark.read.schema(in_order.schema).parquet(f"{path}/postings")
    counts = postings.groupBy("bucket", "gram").agg(F.count("*").alias("n")).repartitionByRange("bucket", "gram")
    counts.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/counts")
    stored.agg(F.count("*").alias("n"), F.lit(numbered.schema.json()).alias("columns")).write.parquet(f"{path}/size")


def _of_grams(spark: SparkSession, path: str, table: str, columns: str, grams: list[int]) -> DataFrame:
    rows = spark.read.schema(f"{columns}, bucket int").parquet(f"{path}/{table}")
    return rows.where(F.col("bucket").isin(sorted({g % BUCKETS for g in grams})) & F.col("gram").isin(grams))


def containing(spark: SparkSession, path: str, pattern: str, column: str = "text") -> DataFrame:
    """The rows written to ``path`` whose text contains ``pattern`` in any case.

    A pattern under three letters, and one whose trigrams are all frequent, reads all rows.
    """
    size = spark.read.parquet(f"{path}/size").first()
    stored = spark.read.schema(StructType.fromJson(json.loads(size["columns"]))).parquet(f"{path}/rows")
    exact = F.contains(F.lower(column), F.lit(pattern.lower()))
    grams = spark.range(1).select(trigrams(F.lit(pattern.lower())).alias("g")).first()["g"]
    if not grams:
        return stored.where(exact).drop(*OWN)
    counts = {r.gram: r.n for r in _of_grams(spark, path, "counts", "gram bigint, n bigint", grams).collect()}
    if len(counts) < len(grams):
        return stored.where(F.lit(False)).drop(*OWN)
    rarest = sorted(grams, key=lambda g: (counts[g], g))[:RAREST]
    if counts[rarest[0]] > SCAN_SHARE * size["n"]:
        return stored.where(exact).drop(*OWN)
    held = _of_grams(spark, path, "postings", "index_row bigint, index_block int, gram bigint", rarest)
    candidates = held.groupBy("index_block", "index_row").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest))
    blocks = [r.index_block for r in candidates.select("index_block").distinct().collect()]
    return stored.where(F.col("index_block").isin(blocks) & exact).drop(*OWN)
