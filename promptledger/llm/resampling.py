"""Target-distribution importance resampling by segment deduplication.

Features are hashed words and pairs of neighbouring words; a bucket's gain tells how
much commoner it is in the target than in the documents. Documents are drawn without
replacement by the mean gain of their features plus Gumbel noise of their id.

1. Newlines, which end words, cut texts into lines. Equal lines are counted, and the
   features of each different line are hashed once.
2. Pairs that cross lines are hashed for each document, from its lines' ends.
3. Corpus counts are the lines' counts times their occurrences, plus the pairs across.
4. A line's gains are summed once and joined to its occurrences; lines with a large
   share of all occurrences are few, so they are broadcast and never shuffled.
5. Ranks come from a range-partitioned sort and the sizes of its partitions.

Rows are named by two 64-bit hashes of id and text; equal rows are counted under one
name and told apart again at the end. Null texts have no words. A null id draws its
noise as an empty one and comes first among ties.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, chain
from math import floor, log
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, table, written

BUCKETS = 10_000
PERCENT = 25
SEED = 7
LEAST_WORDS = 20
#: Lines with more than a share of 1 / MOST_HOT of all occurrences are fewer than this: their gains are broadcast.
MOST_HOT = 10_000
#: Bytes of lines whose features are hashed at once about.
CHUNK_BYTES = 1 << 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SEPARATORS = bytes(b for b in range(128) if not _WORD.match(bytes([b])))
#: Java's pattern for a letter of a word, before A-Z are lower-cased.
_LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: crc32's table: the register's next state for its lowest byte.
_STEP = np.array([crc32(bytes([b ^ 255])) for b in range(256)], np.uint32) ^ np.uint32(0xFF000000)


def _after_space(codes: np.ndarray) -> np.ndarray:
    """crc32 of what has the crc32 ``codes``, followed by a space."""
    state = ~codes
    return ~(_STEP[(state ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (state >> np.uint32(8)))


def line_features(lines: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of all lines, line by line, and how many each line has."""
    found = [_WORD.findall(x.lower()) for x in lines]  # bytes.lower() changes A-Z alone
    words = list(chain.from_iterable(found))
    n = np.fromiter(map(len, found), np.int64, len(found))
    own = np.fromiter(map(crc32, words), np.uint32, len(words))
    owner = np.repeat(np.arange(len(lines)), n)
    inside = owner[1:] == owner[:-1]
    pairs = np.fromiter(map(crc32, words[1:], _after_space(own[:-1]).tolist()), np.uint32, max(0, len(words) - 1))[inside]
    order = np.argsort(np.concatenate([owner, owner[1:][inside]]), kind="stable")
    return np.concatenate([own, pairs])[order] % np.uint32(buckets), 2 * n - (n > 0)


def crossing(text: bytes, buckets: int) -> list[int]:
    """Buckets of the word pairs of a text that cross lines."""
    out, last = [], None
    for line in text.lower().split(b"\n"):
        if line := line.strip(_SEPARATORS):
            if last is not None:
                out.append(crc32(last + b" " + _WORD.match(line).group()) % buckets)
            last = _WORD.match(line[::-1]).group()[::-1]
    return out


def _named(docs: DataFrame) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(doc_id, text).select(*_key("doc_id", "text"), "doc_id", "text")


def _key(*columns: str) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit(1), *columns).alias("k2")]


def _lines(rows: DataFrame) -> DataFrame:
    """The lines of every row that hold a word."""
    return rows.select(*[c for c in rows.columns if c != "text"], F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(_LETTER))


def _packed(flat: np.ndarray, n: np.ndarray) -> list[bytes]:
    ends = np.cumsum(n)
    data = flat.astype("<u2").tobytes()
    return [data[2 * a : 2 * b] for a, b in zip((ends - n).tolist(), ends.tolist())]


def counted_lines(rows: DataFrame, buckets: int) -> DataFrame:
    """``h1, h2, n, features``: every different line of ``rows(text)``, how often it occurs, its features' buckets (16 bits each)."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lines, a, size = pdf["line"].tolist(), 0, 0
            for b, line in enumerate(lines, 1):
                size += len(line)
                if size >= CHUNK_BYTES or b == len(lines):
                    yield pdf.iloc[a:b][["h1", "h2", "n"]].assign(features=_packed(*line_features(lines[a:b], buckets)))
                    a, size = b, 0

    lines = _lines(rows.select("text")).groupBy("line").agg(F.count("*").alias("n"))
    named = lines.select(*[k.alias(f"h{i}") for i, k in enumerate(_key("line"), 1)], "n", F.col("line").cast("binary").alias("line"))
    return named.mapInPandas(hashed, "h1 long, h2 long, n long, features binary")


def crossed_rows(rows: DataFrame, buckets: int) -> DataFrame:
    """``k1, k2, doc_id, n, features`` of every row: its pairs across lines; n is 1."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [np.array(crossing(t, buckets), "<u2").tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"k1": pdf["k1"], "k2": pdf["k2"], "doc_id": pdf["doc_id"].astype("Int64"), "n": 1, "features": found})

    return rows.withColumn("text", F.col("text").cast("binary")).mapInPandas(hashed, "k1 long, k2 long, doc_id long, n long, features binary")


def totals(parts: list[DataFrame], buckets: int) -> np.ndarray:
    """How often each bucket occurs in tables ``(n, features)``: one row a bucket comes to the driver."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(buckets, np.int64)
        for pdf in batches:
            sizes = pdf["features"].map(len).to_numpy() // 2
            flat = np.frombuffer(b"".join(pdf["features"]), "<u2")
            out += np.bincount(flat, np.repeat(pdf["n"].to_numpy(np.float64), sizes), buckets).astype(np.int64)
        yield pd.DataFrame({"bucket": np.arange(buckets, dtype=np.int32), "times": out})

    rows = None
    for part in parts:
        found = part.select("n", "features").mapInPandas(summed, "bucket int, times long")
        rows = found if rows is None else rows.unionByName(found)
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("times").alias("times")).collect():
        out[r["bucket"]] = r["times"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousands of the logarithm of each bucket's smoothed share in the target over that in the corpus, floored."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    one = lambda s, t: floor(1000 * log(((t + 1) * (s_all + n)) / ((s + 1) * (t_all + n))))
    return np.array([one(float(s), float(t)) for s, t in zip(corpus, target)], np.int64)


def _gained(found: DataFrame, gains: np.ndarray, names: str) -> DataFrame:
    """Columns ``names`` of ``found(features)``, with the sum of their features' gains and their number."""
    kept = [c.split()[0] for c in names.split(", ")]

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = pdf["features"].map(len).to_numpy(np.int64) // 2
            running = np.concatenate([[0], np.cumsum(gains[np.frombuffer(b"".join(pdf["features"]), "<u2")])])
            ends = np.cumsum(n)
            out = pdf[kept].assign(gain=running[ends] - running[ends - n], n_features=n)
            yield out.astype({"doc_id": "Int64"}) if "doc_id" in kept else out

    return found.mapInPandas(summed, names + ", gain long, n_features long")


def weighted(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``k1, k2, doc_id, n_features, weight`` of every row of ``docs(doc_id, text)``: the floored mean gain against ``target(text)``."""
    rows = _named(docs)
    lines = written(counted_lines(rows, buckets), "resample-lines")
    across = written(crossed_rows(rows, buckets), "resample-crossing")
    wanted = target.select(F.lit(0).alias("doc_id"), "text")
    aims = _named(wanted)
    gains = gains_of(totals([lines, across], buckets), totals([counted_lines(aims, buckets), crossed_rows(aims, buckets)], buckets))
    worth = written(_gained(lines, gains, "h1 long, h2 long, n long"), "resample-line-gains")
    often = (worth.agg(F.sum("n")).first()[0] or 0) // MOST_HOT
    hot = F.broadcast(worth.where(F.col("n") > often).drop("n"))  # fewer than MOST_HOT lines
    places = _lines(rows.select("k1", "k2", "text")).select("k1", "k2", *[k.alias(f"h{i}") for i, k in enumerate(_key("line"), 1)])
    joined = places.join(hot, ["h1", "h2"], "left")
    held = joined.where("gain is not null").select("k1", "k2", "gain", "n_features")
    rest = joined.where("gain is null").select("k1", "k2", "h1", "h2").join(worth.where(F.col("n") <= often), ["h1", "h2"]).select("k1", "k2", "gain", "n_features")
    parts = held.unionByName(rest).withColumns({"doc_id": F.lit(None).cast("long"), "copies": F.lit(0)})
    parts = parts.unionByName(_gained(across, gains, "k1 long, k2 long, doc_id long").withColumn("copies", F.lit(1)))
    sums = parts.groupBy("k1", "k2").agg(F.max("doc_id").alias("doc_id"), F.sum("copies").alias("copies"), F.sum("gain").alias("gain"), F.sum("n_features").alias("n"))
    each = sums.select("k1", "k2", "doc_id", F.expr("n div copies").alias("n_features"), "gain", "n", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    weight = F.when(F.col("n") > 0, F.expr("(gain - pmod(gain, n)) div n")).otherwise(F.lit(0).cast("long"))
    return each.select("k1", "k2", "doc_id", "n_features", weight.alias("weight"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of an id in thousandths, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """``k1, k2, doc_id, n_features, weight, score, rank`` of every row of ``docs(doc_id, text)``.

    Rank counts the drawn from 1: the ``percent`` of the rows with ``least_words`` words that
    score highest, ties to the smaller id; it is null for the others.
    """
    rows = written(weighted(docs, target, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resample-scores")
    fit = F.col("n_features") >= 2 * least_words - 1  # n words have 2n - 1 features
    most = percent * rows.where(fit).count() // 100
    n, order = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["unfit", F.desc("score"), "doc_id"]
    dealt = rows.withColumn("unfit", ~fit).repartitionByRange(n, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = written(dealt.withColumns({"part": F.spark_partition_id(), "place": place}), "resample-order")
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())  # a number for each partition
    ends = list(accumulate(n for _, n in sizes))
    starts = docs.sparkSession.createDataFrame([(part, end - n) for (part, n), end in zip(sizes, ends)], "part int, start long")
    rank = F.col("start") + F.col("place") + 1
    ranked = placed.join(F.broadcast(starts), "part").withColumn("rank", F.when(~F.col("unfit") & (rank <= most), rank))
    return ranked.select("k1", "k2", "doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their columns as they are; equal rows are drawn together."""
    names = [free_name("_k1", docs), free_name("_k2", docs)]
    drawn = scored(docs, target, percent, seed).where("rank is not null").select(F.col("k1").alias(names[0]), F.col("k2").alias(names[1])).distinct()
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns({names[0]: F.xxhash64(doc_id, text), names[1]: F.xxhash64(F.lit(1), doc_id, text)})
    return keyed.join(drawn, names, "left_semi").select(docs.columns)


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` against the texts of ``benchmark``: 25 % of those with 20 words are drawn.

    Null and empty texts have no features and weight 0; null ids draw the noise of an empty id; equal rows have ranks of their own.
    """
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return scored(docs.select("doc_id", "text"), target).select("doc_id", "n_features", "weight", "score", "rank")
