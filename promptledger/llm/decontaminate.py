"""Benchmark decontamination with DataFrame functions alone.

Words are lower-case runs of letters and digits, shingles five of them (a shorter
text makes one). Item-sized windows of the documents get a 64-bit SimHash of
their shingles; multi-index Hamming blocks find every item whose fingerprint is
within RADIUS; weighted Jaccard similarity (a shingle's weight is its count) of
SIMILARITY or more decides.

Windows are made only where they can pass: a window as similar as that holds 8 of
9 of its item's shingles at least, so every window of an item's size is made that
has as many places of such shingles. None that can pass is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, table, written

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BITS = 64
#: Every block is looked up with up to BLOCK_FLIPS bits changed, so some block of any
#: fingerprint within RADIUS is found. At similarity 0.8 SimHashes differ in 9.7 of
#: 64 bits on average (deviation 2.9).
BLOCK_WIDTHS = (13, 13, 13, 13, 12)
BLOCK_FLIPS = 3
RADIUS = len(BLOCK_WIDTHS) * (BLOCK_FLIPS + 1) - 1
#: The benchmark's shingles are broadcast up to this many, else joined by shuffle.
BROADCAST_SHINGLES = 1_000_000
#: So are up to this many keys of documents; beyond, texts are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def with_shingles(rows: DataFrame) -> DataFrame:
    """Add ``n`` (words) and ``shingles`` (hashes in order) to rows that have ``text``."""
    hashed = rows.withColumn("wh", F.transform(words_of(F.col("text").cast("string")), lambda w: F.xxhash64(w)))
    n = F.size("wh")
    several = F.transform(F.sequence(F.lit(0), n - SHINGLE_WORDS), lambda i: F.xxhash64(*[F.get("wh", i + k) for k in range(SHINGLE_WORDS)]))
    one = F.array(F.xxhash64("wh"))
    shingles = F.when(n >= SHINGLE_WORDS, several).when(n > 0, one).otherwise(F.array().cast("array<bigint>"))
    return hashed.withColumns({"n": n, "shingles": shingles}).drop("wh")


def simhash(shingles: Column) -> Column:
    """64 bits, each the majority of that bit in the shingles' hashes."""
    n = F.size(shingles)
    bit = lambda b: F.aggregate(shingles, F.lit(0), lambda a, h: a + F.getbit(h, b))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        F.lit(0).cast("long"),
        lambda a, b: F.when(bit(b) * 2 > n, a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(a),
    )


def block(fingerprint: Column, k: int) -> Column:
    return F.shiftrightunsigned(fingerprint, sum(BLOCK_WIDTHS[:k])).bitwiseAND(F.lit((1 << BLOCK_WIDTHS[k]) - 1).cast("long"))


def flips(width: int) -> list[int]:
    """All changes of up to BLOCK_FLIPS bits of a block."""
    masks = {0}
    for _ in range(BLOCK_FLIPS):
        masks |= {m ^ (1 << b) for m in masks for b in range(width)}
    return sorted(masks)


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two multisets; repeated members are counted only where one has some."""
    times = lambda rows, x: F.size(F.filter(rows, lambda y: y == x))
    both = F.array_intersect(a, b)
    single = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    return F.when(single, F.size(both)).otherwise(F.aggregate(both, F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x))))


def _key() -> Column:
    """128 bits that stand for a row's id and text: null and repeated ids do no harm."""
    return F.unhex(F.md5(F.concat_ws("\0", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.col("text").cast("string"), F.lit("")))))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", _key().alias("key"))


def _small(keys: DataFrame) -> DataFrame:
    """``keys`` (a read table's), to be broadcast if they are counted as few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The best window of every contaminated document and item: key, doc_id, item_id,
    start, n_words, similarity, distance. Null or empty texts on either side match nothing."""
    items = with_shingles(benchmark.select("item_id", F.col("text").cast("string").alias("text"))).where("n > 0")
    items = written(items.select("item_id", F.col("n").alias("size"), F.col("shingles").alias("own")), "items")
    places = items.select("item_id", "size", F.size("own").alias("m"), F.posexplode("own").alias("at", "h"))
    keyed = _keyed(docs)
    # the outer form: an inner one would have its non-empty test, and with it all of the hashing, run again before it
    found = with_shingles(keyed).select("key", "n", F.posexplode_outer("shingles").alias("pos", "h"))
    few = places.groupBy("h").agg(F.collect_list(F.struct("item_id", "size", "m", "at")).alias("places"))
    if places.count() <= BROADCAST_SHINGLES:
        few = F.broadcast(few)
    hits = written(found.join(few, "h").select("key", "n", "pos", F.explode("places").alias("p")).select("key", "n", "pos", "p.*"), "benchmark-hits")
    places = hits.groupBy("key", "item_id").agg(*[F.first(c).alias(c) for c in ("n", "size", "m")], F.sort_array(F.collect_set("pos")).alias("places"))
    # similar sets of a and m shingles share 4 in 9 of a + m; a window has m, in a shorter document fewer
    held = F.least("m", F.greatest(F.col("n") - SHINGLE_WORDS + 1, F.lit(1)))
    places = places.withColumn("need", F.ceil(SIMILARITY / (1 + SIMILARITY) * (F.col("m") + held) - 1e-9).cast("int")).where(F.size("places") >= F.col("need"))
    # a window has that many places if it begins at or before one and ends at or after the one that many further on
    last = F.greatest(F.lit(0), F.col("n") - F.col("size"))
    runs = places.select("key", "size", "m", "places", "need", last.alias("last"), F.explode(F.sequence(F.lit(0), F.size("places") - F.col("need"))).alias("j"))
    lo, hi = F.greatest(F.lit(0), F.get("places", F.col("j") + F.col("need") - 1) - F.col("m") + 1), F.least(F.get("places", F.col("j")), F.col("last"))
    runs = runs.select("key", "size", lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    starts = written(runs.select("key", "size", F.explode(F.sequence("lo", "hi")).alias("start")).distinct(), "benchmark-starts")
    texts = with_shingles(keyed.join(_small(starts.select("key").distinct()), "key", "left_semi").dropDuplicates(["key"])).select("key", "doc_id", "shingles")
    length = F.greatest(F.lit(1), F.col("size") - SHINGLE_WORDS + 1)
    windows = starts.join(texts, "key").select("key", "doc_id", "size", "start", F.slice("shingles", F.col("start") + 1, length).alias("window"))
    windows = written(windows.withColumn("fingerprint", simhash(F.col("window"))), "benchmark-windows")
    numbered = lambda print_: F.array(*[F.struct(F.lit(k).alias("block"), block(F.col(print_), k).alias("value")) for k in range(len(BLOCK_WIDTHS))])
    blocked = windows.select("key", "size", "start", "fingerprint", F.inline(numbered("fingerprint")))
    prints = items.withColumn("print", simhash(F.col("own")))
    masks = F.expr("array(" + ", ".join("array(" + ", ".join(f"{m}L" for m in flips(w)) + ")" for w in BLOCK_WIDTHS) + ")")
    index = prints.select("size", "item_id", "print", F.inline(numbered("print")))
    index = index.select("size", "item_id", "print", "block", F.explode(F.transform(F.get(masks, F.col("block")), lambda m: F.col("value").bitwiseXOR(m))).alias("value"))
    other = F.col("fingerprint").bitwiseXOR(F.col("print"))
    # a pair may meet in several blocks: only the first counts
    first = F.lit(True)
    for k in range(len(BLOCK_WIDTHS) - 1):
        first = first & ((blocked["block"] <= k) | (F.bit_count(block(other, k)) > BLOCK_FLIPS))
    same = (blocked["size"] == index["size"]) & (blocked["block"] == index["block"]) & (blocked["value"] == index["value"])
    near = blocked.join(index, same & (F.bit_count(other) <= RADIUS) & first).select("key", blocked["size"], "start", "item_id", F.bit_count(other).alias("distance"))
    near = near.join(windows.select("key", "doc_id", "size", "start", "window"), ["key", "size", "start"]).join(items.select("item_id", "own"), "item_id")
    both = overlap(F.col("window"), F.col("own"))
    judged = near.withColumn("both", both).withColumn("similarity", F.col("both") / (F.size("window") + F.size("own") - F.col("both")))
    good = judged.where(F.col("similarity") >= SIMILARITY)
    best = good.groupBy("key", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "size", "doc_id", "distance")).alias("b"))
    return best.select("key", "b.doc_id", "item_id", F.col("b.start").cast("long").alias("start"), F.col("b.size").cast("long").alias("n_words"), (-F.col("b.s")).alias("similarity"), F.col("b.distance").cast("long").alias("distance"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a passage of the benchmark; null and empty texts stay."""
    own = free_name("_key", docs)
    keys = written(contaminations(docs, benchmark).select(F.col("key").alias(own)).distinct(), "contaminated")
    return docs.withColumn(own, _key()).join(_small(keys), own, "left_anti").select(docs.columns)


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id and the best window of every contaminated document and item."""
    found = contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", F.round("similarity", 6).alias("similarity"))


ORACLE_SQL = r"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents where text is not null),
b as (
  select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark where text is not null),
ds as (
  select doc_id, len(w) as n, i, array_to_string(w[i + 1:i + 5], ' ') as s
  from (select doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) as i from d where len(w) > 0)),
bs as (
  select item_id, len(w) as size, j, array_to_string(w[j + 1:j + 5], ' ') as s
  from (select item_id, w, unnest(range(0, greatest(len(w) - 4, 1))) as j from b where len(w) > 0)),
own as (select item_id, size, s, count(*) as c from bs group by all),
items as (select item_id, size, sum(c) as m from own group by all),
hits as (select doc_id, n, i, item_id, size, s, c from ds join own using (s)),
inside as (  -- every window of the item's size that holds some place of its shingles
  select doc_id, item_id, n, size, start, s, least(count(*), any_value(c)) as c
  from (select *, unnest(range(greatest(0, i - greatest(size - 4, 1) + 1), least(i, greatest(n - size, 0)) + 1)) as start from hits) group by doc_id, item_id, n, size, start, s),
shared as (select doc_id, item_id, n, size, start, sum(c) as hit from inside group by all),
scored as (
  select doc_id, item_id, shared.size, start, hit / (greatest(least(shared.size, n) - 4, 1) + m - hit) as sim from shared join items using (item_id))
select doc_id, item_id, cast(start as bigint) as start, cast(size as bigint) as n_words, round(sim, 6) as similarity
from (select *, row_number() over (partition by doc_id, item_id order by sim desc, start) as rn from scored where sim >= 0.8)
where rn = 1
"""
