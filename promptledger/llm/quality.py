"""Supervised subword embeddings for document quality.

A word's vector is the mean of the learned vectors of its hashed features (the
word, its character n-grams); a document's vector is the mean of its words' and
of one more token for each word equal to the word before it (a hashed word pair
"same again"); a softmax over two outputs gives the score. Vectors and outputs
are fitted by numpy stochastic gradient descent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, table

BUCKETS = 1 << 16
#: The feature of a word equal to the one before: the word pair "same again" under one hash, whatever the word.
AGAIN = BUCKETS
DIM = 12
GRAMS = (2, 3, 4)
#: Labelled documents of each class that the fit takes at most (by a hash of the id).
SAMPLE_PER_CLASS = 1200
#: Bytes of features of each class that the driver holds at most; rows beyond, by the same hash, are not fitted.
SAMPLE_BYTES = 96 << 20
EPOCHS = 12
RATE = 0.6
#: Words that a scoring worker remembers; when full, it starts again.
MAX_REMEMBERED = 400_000
MAX_WORD = 48


def word_features(word: str) -> list[int]:
    """Hashed features of a word: itself and the n-grams of ``<word>``."""
    b = f"<{word}>".encode("utf-32-le", "surrogatepass")
    mask = BUCKETS - 1
    out = [crc32(b) & mask]
    for n in GRAMS:
        k = 4 * n
        out += [crc32(b[i : i + k], n) & mask for i in range(0, len(b) - k + 1, 4)]
    return out


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse weights of a text's features; they sum to 1, none for a text without words."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    distinct = {w: k for k, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(distinct.__getitem__, words), np.int64, len(words))
    counts = np.bincount(codes)
    again = int((codes[1:] == codes[:-1]).sum())
    ids, weights = [np.array([AGAIN])], [np.array([float(again)])]
    for w, n in zip(distinct, counts):
        f = word_features(w)
        ids.append(np.array(f))
        weights.append(np.full(len(f), n / len(f)))
    total = np.bincount(np.concatenate(ids), np.concatenate(weights), BUCKETS + 1) / (len(words) + again)
    at = np.nonzero(total)[0]
    return at.astype(np.int32), total[at].astype(np.float32)


@dataclass
class QualityModel:
    vectors: np.ndarray  # (BUCKETS + 1, DIM)
    outputs: np.ndarray  # (DIM, 2)
    bias: np.ndarray  # (2,)

    def feature_logits(self) -> np.ndarray:
        """Each feature's share of the logit of class 1 over class 0."""
        return (self.vectors @ (self.outputs[:, 1] - self.outputs[:, 0])).astype(np.float64)


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray, int, float]], seed: int = 7) -> QualityModel:
    """SGD over (feature ids, weights, label, row weight)."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 1, DIM)).astype(np.float32)
    w = rng.uniform(-1, 1, (DIM, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    steps, done = EPOCHS * max(1, len(rows)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            ids, x, y, weight = rows[k]
            rate = RATE * weight * (1 - done / steps)
            done += 1
            own = e[ids]
            h = x @ own
            z = h @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = w @ p
            w -= rate * np.outer(h, p)
            b -= rate * p
            # x sums to 1 over many features: a step of its own length keeps rare features learning
            e[ids] = own - (rate / float(x @ x) ** 0.5) * np.outer(x, back)
    return QualityModel(e, w, b)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, most_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """Learn from labelled documents whose crc32(doc_id) mod 3 is not 1.

    At most ``per_class`` rows of each label and ``most_bytes`` of their features,
    those of smallest id hash; row weights restore the labels' shares. Without
    labels every score is 0.5. Null ids and labels are not learned from, nor ids with
    both labels; of an id with several texts the one of least hash is.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("quality in (0, 1) and crc32(cast(doc_id as string)) % 3 <> 1")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    counts = dict(known.groupBy("quality").count().collect())
    taken = [known.where(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    sample = taken[0].union(taken[1])  # 2 * per_class rows at most

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [document_features(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality": pdf["quality"], "ids": [a.tobytes() for a, _ in both], "weights": [b.tobytes() for _, b in both]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    found = texts.mapInPandas(features, "doc_id long, quality int, ids binary, weights binary")
    order = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    held = found.withColumn("held", F.sum(F.length("ids") + F.length("weights")).over(order)).where(F.col("held") <= most_bytes)
    rows = [(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32), q) for _, q, i, x in sorted(held.select("doc_id", "quality", "ids", "weights").collect()) if i]
    total = sum(counts.values()) or 1
    n = {c: sum(q == c for _, _, q in rows) or 1 for c in (0, 1)}
    share = {c: counts.get(c, 0) / total * len(rows) / n[c] for c in (0, 1)}
    return fit_rows([(i, x, q, share[q] ** 0.5) for i, x, q in rows])


def score(docs: DataFrame, model: QualityModel, into: str = "score") -> DataFrame:
    """``docs`` with ``into`` (``score``): the probability of label 1 of every whole text.

    A text without words has the score of the outputs' bias alone.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((model.feature_logits(), float(model.bias[1] - model.bias[0])))

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        logits, bias = shared.value
        logits = logits.tolist()
        again, known = logits[AGAIN], {}

        def of(word: str) -> float:
            f = word_features(word)
            return sum([logits[i] for i in f]) / len(f)

        for texts in batches:
            out = []
            for text in texts:
                words = text.split() if text else []
                if not words:
                    out.append(bias)
                    continue
                if len(known) > MAX_REMEMBERED:
                    known.clear()
                for w in set(words).difference(known):
                    if len(w) <= MAX_WORD:
                        known[w] = of(w)
                total, same = 0.0, 0
                try:
                    total = sum(map(known.__getitem__, words))
                except KeyError:
                    total = sum(known[w] if w in known else of(w) for w in words)
                same = sum(map(str.__eq__, words[1:], words))
                out.append((total + same * again) / (len(words) + same) + bias)
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -500, 500))))

    return docs.withColumn(into, F.pandas_udf(scored, "double")(F.col("text").cast("string")))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, with their own columns; the model learns from the labelled ones."""
    own = free_name("_quality", docs)
    return score(docs, fit(docs, labels), own).where(F.col(own) >= 0.5).select(docs.columns)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``; null texts count as empty, null ids are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
