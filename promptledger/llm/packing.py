"""Bounded-space online best-fit packing of token pieces into sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encoder
from .shared import table, written

END = b"\0\0\0\0"
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED_SCHEMA = PIECE_SCHEMA + ", bin long, offset long"
#: Open bins of one packing task.
OPEN_BINS = 1024
#: Pieces that one packing task takes about: few enough for short tasks, so
#: many that the bins left open at its end are a thousandth of its sequences.
TASK_PIECES = 500_000


class OpenBins:
    """A fixed number of open bins, found by free space.

    Bit ``f`` of ``free`` is set while some open bin has ``f`` free places; the
    smallest fitting bin is the lowest set bit from the wanted length on, the
    fullest open bin is the lowest set bit of all and closes first.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = 0
        self.made = 0

    def _put(self, number: int, free: int) -> None:
        self.by_free[free].append(number)
        self.free |= 1 << free
        self.open += 1

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.free &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece of ``length``, 1 to the capacity."""
        fits = self.free >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.most and length < self.capacity:
                self._take((self.free & -self.free).bit_length() - 1)
            free, number = self.capacity, self.made
            self.made += 1
        if free > length:
            self._put(number, free - length)
        return number, self.capacity - free


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int, spaced: bool = False) -> DataFrame:
    """Pieces of every document ``(doc_id, text)``: its ids, then id 0, cut only beyond ``capacity``.

    Null and empty texts are one piece of the end id; null doc_ids and repeated rows are kept.
    """
    step = 4 * capacity

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary, spaced)
        for pdf in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for doc_id, b in zip(pdf["doc_id"].tolist(), enc.encode(pdf["text"])):
                b += END
                for k, at in enumerate(range(0, len(b), step)):
                    own = b[at : at + step]
                    ids.append(doc_id)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            yield pd.DataFrame({"doc_id": pd.array([None if d is None or d != d else int(d) for d in ids], "Int64"), "piece": np.array(piece, np.int32), "start": start, "length": length, "ids_crc32": crc})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(pieces, PIECE_SCHEMA)


def best_fit(pieces: DataFrame, capacity: int, open_bins: int = OPEN_BINS, task_pieces: int = TASK_PIECES) -> DataFrame:
    """Add ``sequence_id, offset`` to ``pieces``; every piece is placed once, without gaps.

    Pieces are dealt by a hash of document and piece, so tasks get even shares of
    a hot source, and taken in that order, so a lost task gives the same bins.
    """
    pieces = written(pieces, "pieces")
    tasks = max(1, -(-pieces.count() // task_pieces))
    key = F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32")
    dealt = pieces.withColumn("key", key).repartition(tasks, "key").sortWithinPartitions("key", "doc_id", "piece")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = OpenBins(capacity, open_bins)
        for pdf in batches:
            at = [bins.place(n) for n in pdf["length"].tolist()]
            yield pdf.drop(columns="key").assign(doc_id=pdf["doc_id"].astype("Int64"), bin=[a for a, _ in at], offset=[b for _, b in at])

    placed = dealt.mapInPandas(place, PLACED_SCHEMA)
    number = (F.spark_partition_id().cast("long") * F.lit(1 << 40) + F.col("bin")).alias("sequence_id")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", number, "offset")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048) -> DataFrame:
    """The pieces of ``docs(doc_id, text)`` and their places in sequences of at most ``capacity`` ids.

    Null and empty texts are one piece of the end id; rows of null and repeated ids are
    packed like others. Pieces of equal length take bins in the order of a hash, so the
    same input gives the same places. No rows, no pieces. Other columns are not read.
    """
    return best_fit(cut_pieces(docs, vocabulary, capacity), capacity)


def op3_best_fit(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents`` into sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
