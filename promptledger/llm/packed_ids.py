"""Token ids in fixed-width bit-packed segments, read back block by block.

File format: a folder of Parquet files written by Spark, one row for each
segment: ``part, seg`` (their order is the order of ids), ``n_ids``, ``doc_ids``
and ``doc_lens`` (the documents in it, in order) and ``payload``. A payload is

    8 bytes  magic ``PLIDS001``
    u4 bits of an id, u4 ids of a block, u8 ids, u8[blocks + 1] block offsets
    blocks: 32 ids fill exactly ``bits`` little-endian 32-bit words

so any block is found from its offset and unpacked by 32 vector operations.
Segments hold whole documents and close at SEGMENT_IDS ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import encoder
from .shared import table, written

MAGIC = b"PLIDS001"
BLOCK_IDS = 4096
SEGMENT_IDS = 1 << 19
SEGMENT_SCHEMA = "part int, seg int, n_ids long, doc_ids array<bigint>, doc_lens array<bigint>, payload binary"
END = b"\0\0\0\0"


def pack(ids: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    """A segment's payload; ``block_ids`` is a multiple of 32. An id that needs more bits is refused."""
    n = len(ids)
    if n and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit {bits} bits")
    rows = -(-n // 32)
    lanes = np.zeros((rows * 32,), np.uint64)
    lanes[:n] = ids
    lanes = lanes.reshape(rows, 32)
    words = np.zeros((rows, bits + 1), np.uint64)
    for j in range(32):
        at, shift = divmod(j * bits, 32)
        v = lanes[:, j] << np.uint64(shift)
        words[:, at] |= v & np.uint64(0xFFFFFFFF)
        words[:, at + 1] |= v >> np.uint64(32)
    body = words[:, :bits].astype("<u4").tobytes()
    blocks = -(-n // block_ids)
    offsets = np.minimum(np.arange(blocks + 1, dtype="<u8") * (block_ids // 32 * bits * 4), len(body))
    head = np.array([bits, block_ids], "<u4").tobytes() + np.array([n], "<u8").tobytes()
    return MAGIC + head + offsets.astype("<u8").tobytes() + body


def unpack(payload: bytes, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Ids ``lo`` to ``hi`` of a payload; only the blocks that hold them are unpacked."""
    if payload[:8] != MAGIC:
        raise ValueError("not a packed segment")
    bits, block_ids = (int(x) for x in np.frombuffer(payload, "<u4", 2, 8))
    n = int(np.frombuffer(payload, "<u8", 1, 16)[0])
    hi = n if hi is None else min(hi, n)
    if lo >= hi:
        return np.zeros(0, "<u4")
    blocks = -(-n // block_ids)
    offsets = np.frombuffer(payload, "<u8", blocks + 1, 24)
    base = 24 + 8 * (blocks + 1)
    first, last = lo // block_ids, (hi - 1) // block_ids
    begin, end = base + int(offsets[first]), base + int(offsets[last + 1])
    words = np.frombuffer(payload, "<u4", (end - begin) // 4, begin).reshape(-1, bits).astype(np.uint64)
    out = np.empty((len(words), 32), "<u4")
    mask = np.uint64((1 << bits) - 1)
    for j in range(32):
        at, shift = divmod(j * bits, 32)
        v = words[:, at] >> np.uint64(shift)
        if shift + bits > 32:
            v |= words[:, at + 1] << np.uint64(32 - shift)
        out[:, j] = v & mask
    return out.reshape(-1)[lo - first * block_ids : hi - first * block_ids]


def vocabulary_bits(vocabulary: str) -> int:
    """The least bits that hold every id of a vocabulary, added tokens included."""
    from tokenizers import Tokenizer

    return max(1, max(Tokenizer.from_file(vocabulary).get_vocab(with_added_tokens=True).values()).bit_length())


def write_packed(docs: DataFrame, vocabulary: str, spaced: bool = True, partitions: int | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write its segments in ascending doc_id order.

    A null or empty text has the end id only. Null doc_ids come first, repeated
    ones are kept, in the order of their texts. Other columns are not read.
    ``partitions`` (by default the session's shuffle partitions) bounds no memory:
    a task holds one segment and one batch at a time, whatever its share.
    """
    bits = vocabulary_bits(vocabulary)

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seg = TaskContext.get().partitionId(), 0
        enc = encoder(vocabulary, spaced)
        ids, lens, parts, size = [], [], [], 0

        def close() -> pd.DataFrame:
            flat = np.frombuffer(b"".join(parts), "<u4")
            return pd.DataFrame({"part": [part], "seg": [seg], "n_ids": [len(flat)], "doc_ids": [ids], "doc_lens": [lens], "payload": [pack(flat, bits)]})

        for pdf in batches:
            for doc_id, b in zip(pdf["doc_id"].tolist(), enc.encode(pdf["text"])):
                b += END
                ids.append(None if doc_id != doc_id or doc_id is None else int(doc_id))
                lens.append(len(b) // 4)
                parts.append(b)
                size += len(b) // 4
                if size >= SEGMENT_IDS:
                    yield close()
                    ids, lens, parts, size, seg = [], [], [], 0, seg + 1
        if ids:
            yield close()

    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return written(ordered.mapInPandas(segments, SEGMENT_SCHEMA), "packed-ids")


def segment_starts(segments: DataFrame) -> DataFrame:
    """``part, seg, seg_start``: ids before each segment.

    The ids before a part come from one sum for each part (a few numbers for each
    file); inside a part a window adds its segments.
    """
    per_part = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = per_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seg")) - F.col("n_ids")
    return segments.select("part", "seg", inside.alias("in_part")).join(before, "part").select("part", "seg", (F.col("part_start") + F.col("in_part")).alias("seg_start"))


def read_documents(segments: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32."""

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, seg, doc_ids, lens, payload in pdf[["part", "seg", "doc_ids", "doc_lens", "payload"]].itertuples(index=False):
                flat = unpack(payload).tobytes()
                lens = np.asarray(lens, np.int64)
                ends = np.cumsum(lens)
                yield pd.DataFrame({
                    "part": np.int32(part), "seg": np.int32(seg),
                    "doc_id": pd.array([None if d != d or d is None else int(d) for d in doc_ids], "Int64"),
                    "rel": ends - lens, "n_tokens": lens,
                    "ids_crc32": [zlib.crc32(flat[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lens.tolist())],
                })

    docs = segments.mapInPandas(documents, "part int, seg int, doc_id long, rel long, n_tokens long, ids_crc32 long")
    return docs.join(segment_starts(segments), ["part", "seg"]).select("doc_id", (F.col("seg_start") + F.col("rel")).alias("start"), "n_tokens", "ids_crc32")


def read_range(segments: DataFrame, start: int, n: int) -> DataFrame:
    """Random access: rows (pos, id) of ids ``start`` to ``start + n``; other segments are not opened."""
    starts = segment_starts(segments).where((F.col("seg_start") < start + n))
    hit = segments.join(starts, ["part", "seg"]).where(F.col("seg_start") + F.col("n_ids") > start).select("seg_start", "payload")

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, payload in pdf.itertuples(index=False):
                lo = max(0, start - at)
                ids = unpack(payload, lo, start + n - at)
                yield pd.DataFrame({"pos": at + lo + np.arange(len(ids)), "id": ids.astype(np.int64)})

    return hit.mapInPandas(pick, "pos long, id long")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents`` through write and read; see ``write_packed`` for null and repeated rows."""
    import public_tokenizers

    return read_documents(write_packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
