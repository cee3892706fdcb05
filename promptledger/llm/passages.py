"""Substring dedup: recurring passages found by sharded Aho-Corasick automata.

A window is 20 consecutive words. Its seed is the smallest hash of its six-word
runs (the leftmost of equals), so equal windows have equal seeds.

1. Every document gives its seeds; seeds with one occurrence in all documents
   cannot be in a recurring window.
2. Documents with recurring seeds give units: the windows of one seed place, in
   their text. Each window is in one unit, equal windows have units of one seed.
3. Units meet in shards by their seed. There passages are confirmed: a unit that
   occurs again, and the windows that different units of one seed share, each with
   its first place in all documents. A seed with very many units is confirmed before,
   on its different units (equal ones are counted before any shuffle).
4. Each shard's passages are compiled into an automaton and the shard's units stream
   through it; a passage found after its first place marks its words. The
   units of a seed with very many are dealt over several tasks, its passages to each.
5. Every document drops its marked words.

A unit streams through the one automaton that can hold its windows, so work grows
with the corpus, not with shards times corpus. Rows of equal id and text are judged
as one; those of equal id and different texts by a hash of both.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ascii_words, table, written

WINDOW = 20
SEED_WORDS = 6
SPAN = WINDOW - SEED_WORDS + 1  # seed places of one window
#: Bytes of text that are hashed at once about (a longer text is hashed whole).
CHUNK_BYTES = 1 << 18
#: Bytes of the units of one shard about.
SHARD_BYTES = 1 << 20
#: A seed with more units is hot: it is dealt over several tasks, and with more different units in shards.
HELD_UNITS = 2_000
#: Units of a shard's task, at least, for each of the shard's different units, about as many as it has passages.
UNITS_A_PASSAGE = 16
#: Seeds with more than a share of 1 / MOST_HOT of all places are fewer than this: their list is broadcast.
MOST_HOT = 100_000
#: What a step has found for each document is broadcast up to this size, else joined by shuffle.
BROADCAST_BYTES = 64 << 20
_RANDOM = np.random.default_rng(20)
_MIX = (_RANDOM.integers(1, 1 << 63, SEED_WORDS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_LETTER = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = (int(_RANDOM.integers(1, 1 << 61)) << 2) | 3
_SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.isin(np.arange(256), list(_SPACES))
_TO_SPACE = bytes.maketrans(_SPACES, b" " * len(_SPACES))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the hash's base, and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, CHUNK_BYTES), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS


class Chunk:
    """Words, seeds and units of some texts (bytes), by few operations over all of them.

    ``starts, ends`` are byte places of words, ``owner`` their text. Seed place k is chosen
    by ``windows[k]`` windows from word ``first[k]`` on.
    """

    def __init__(self, texts: list[bytes]):
        self.text = b"\n".join(texts).translate(_TO_SPACE)
        data = np.frombuffer(self.text, np.uint8)
        inside = np.concatenate([[False], ~_IS_SPACE[data], [False]])
        edges = np.nonzero(inside[1:] != inside[:-1])[0]
        self.starts, self.ends = edges[::2], edges[1::2]
        begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
        self.owner = np.searchsorted(begins, self.starts, "right") - 1
        self.n_words = np.bincount(self.owner, minlength=len(texts))
        self.base = np.cumsum(self.n_words) - self.n_words
        self._choose(self._hashes(data))
        #: number of the first seed place of each text, and of all
        self.places = np.searchsorted(self.owner[self.first], np.arange(len(texts) + 1))

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        """A hash of each word: a polynomial of its letters' random numbers, from one running sum."""
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTER[data] * up[: len(data)], out=total[1:])
        return mixed((total[self.ends] - total[self.starts]) * down[self.starts])

    def _choose(self, codes: np.ndarray) -> None:
        n = len(codes) - WINDOW + 1
        if n <= 0:
            self.seeds, self.first, self.windows = (np.zeros(0, np.int64) for _ in range(3))
            return
        m = len(codes) - SEED_WORDS + 1
        h = np.zeros(m, np.uint64)
        for k in range(SEED_WORDS):
            h += codes[k : k + m] * _MIX[k]
        h = mixed(h)
        best, at, width = h, np.arange(m), 1
        while width < SPAN:  # least of runs of 1, 2, 4, 8 and SPAN places, leftmost of equals
            step = min(width, SPAN - width)
            left, right = best[:-step], best[step:]
            take = right < left
            best, at, width = np.where(take, right, left), np.where(take, at[step:], at[:-step]), width + step
        valid = self.owner[:n] == self.owner[WINDOW - 1 :]  # a window is in one text
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
        self.first = np.nonzero(new)[0]
        self.seeds = best[self.first].astype(np.int64)
        self.windows = np.add.reduceat(valid.astype(np.int64), self.first) if len(self.first) else self.first

    def units(self, k: np.ndarray) -> list[bytes]:
        """The text of seed places ``k``: their windows' words, joined by one space."""
        lo, hi = self.starts[self.first[k]], self.ends[self.first[k] + self.windows[k] + WINDOW - 2]
        text = self.text
        out = [text[a:b] for a, b in zip(lo.tolist(), hi.tolist())]
        return [b" ".join(u.split()) if b"  " in u else u for u in out] if b"  " in text else out


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int, Chunk]]:
    """Texts a to b, CHUNK_BYTES about, and their chunk."""
    a = size = 0
    for b, t in enumerate(texts, 1):
        size += len(t)
        if size >= CHUNK_BYTES or b == len(texts):
            yield a, b, Chunk(texts[a:b])
            a, size = b, 0


def _bytes(column: pd.Series) -> list[bytes]:
    return [t if t is not None else b"" for t in column]


def seeds(docs: DataFrame) -> DataFrame:
    """``row, doc_id, n_words, sha256, seeds`` of every row of ``docs(row, doc_id, text)``: its digest as it is, its seeds."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, n_words, own = _bytes(pdf["text"]), [], []
            for _, _, c in chunks(texts):
                n_words += c.n_words.tolist()
                own += np.split(c.seeds, c.places[1:-1])
            digests = []
            for t in texts:
                plain = t.translate(_TO_SPACE)
                if b"  " in plain or plain[:1] == b" " or plain[-1:] == b" ":
                    plain = b" ".join(plain.split())
                digests.append(sha256(plain).hexdigest())
            yield pd.DataFrame({"row": pdf["row"], "doc_id": pdf["doc_id"].astype("Int64"), "n_words": n_words, "sha256": digests, "seeds": own})

    return docs.withColumn("text", F.col("text").cast("binary")).mapInPandas(found, "row long, doc_id long, n_words long, sha256 string, seeds array<long>")


#: ``doc`` is the doc_id, the least number for a null one; ``hot`` tells that the seed has very many units.
UNIT = "seed long, doc long, row long, at int, hot boolean, words binary"


def units(docs: DataFrame) -> DataFrame:
    """Units at the seed places ``places`` (their numbers p within their text, -1 - p for hot seeds) of ``docs(row, doc_id, text, places)``."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            doc, row, wanted = pdf["doc"].to_numpy(), pdf["row"].to_numpy(), pdf["places"].tolist()
            for a, b, c in chunks(_bytes(pdf["text"])):
                own = np.repeat(np.arange(a, b), [len(p) for p in wanted[a:b]])
                if not len(own):
                    continue
                p = np.concatenate(wanted[a:b]).astype(np.int64)
                k = np.where(p < 0, -1 - p, p) + c.places[own - a]
                at = (c.first[k] - c.base[own - a]).astype(np.int32)
                yield pd.DataFrame({"seed": c.seeds[k], "doc": doc[own], "row": row[own], "at": at, "hot": p < 0, "words": c.units(k)})

    least = F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("doc")
    return docs.select("row", least, F.col("text").cast("binary").alias("text"), "places").mapInPandas(cut, UNIT)


def _windows(words: bytes) -> list[bytes]:
    """The windows of a unit."""
    ends = list(accumulate(len(w) + 1 for w in words.split(b" ")))
    return [words[a : b - 1] for a, b in zip([0, *ends], ends[WINDOW - 1 :])]


def sharded(hot: DataFrame) -> DataFrame:
    """Units ``hot`` (with ``salts``, their number of tasks) with their ``shard``: 0, but for seeds with more than HELD_UNITS different units.

    Those are cut into runs of windows of one shard, by a hash of the window; a
    shard has half of HELD_UNITS different windows about, and its own ``salts``, by its
    own pieces: a passage goes to as many tasks as its shard has, and a task has
    UNITS_A_PASSAGE pieces for each, so what is sent is a part of the units.
    """
    whole = hot.withColumn("shard", F.lit(0))
    kinds = hot.groupBy("seed").agg(F.approx_count_distinct("words").alias("kinds"))
    wide = written(kinds.where(F.col("kinds") > HELD_UNITS).select("seed", F.ceil(F.col("kinds") * (2 * SPAN / HELD_UNITS)).cast("int").alias("shards")), "wide-seeds")
    if wide.isEmpty():
        return whole

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            part, at, words, shard = [], [], [], []
            for k, (begin, unit, shards) in enumerate(zip(pdf["at"].tolist(), pdf["words"].tolist(), pdf["shards"].tolist())):
                w = unit.split(b" ")
                own = [xxhash.xxh64_intdigest(x) % shards for x in _windows(unit)]
                a = 0
                for b in range(1, len(own) + 1):
                    if b == len(own) or own[b] != own[a]:
                        part.append(k)
                        at.append(begin + a)
                        words.append(b" ".join(w[a : b + WINDOW - 1]))
                        shard.append(own[a])
                        a = b
            out = pdf[["seed", "doc", "row"]].iloc[part].reset_index(drop=True)
            yield out.assign(at=np.array(at, np.int32), words=words, shard=np.array(shard, np.int32))

    pieces = hot.join(wide, "seed").mapInPandas(cut, "seed long, doc long, row long, at int, words binary, shard int")
    many = pieces.groupBy("seed", "shard").agg(F.count("*").alias("n"), F.approx_count_distinct("words").alias("kinds")).where(F.col("n") > HELD_UNITS)
    salts = F.ceil(F.col("n") / F.greatest(F.lit(HELD_UNITS), F.col("kinds") * UNITS_A_PASSAGE)).cast("int")
    many = written(many.select("seed", "shard", salts.alias("salts")), "hot-shards")
    many = F.broadcast(many) if many.count() <= MOST_HOT else many
    pieces = pieces.join(many, ["seed", "shard"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    return whole.join(wide, "seed", "left_anti").unionByName(pieces)


def confirmed(kinds: list[tuple[bytes, tuple[int, int, int], int]]) -> list[tuple[bytes, int, int, int]]:
    """The passages (words, doc, row, at of their first place) of the different units of one seed and
    shard, given with their first place (doc, row, at) and how often they occur.

    A unit that occurs again is one; so is a run of windows of a unit's first place
    that are, in the same order, at an earlier first place in another unit.
    """
    out = [(words, *place) for words, place, n in kinds if n > 1]
    if len(kinds) == 1:
        return out
    own = [_windows(words) for words, *_ in kinds]
    first: dict[bytes, tuple[int, int, int]] = {}
    for windows, (_, (doc, row, at), _) in zip(own, kinds):
        for i, w in enumerate(windows):
            here = (doc, row, at + i)
            if w not in first or here < first[w]:
                first[w] = here
    for windows, (words, (doc, row, at), _) in zip(own, kinds):
        runs, apart = [], None
        for i, w in enumerate(windows):
            d, r, k = first[w]
            if (d, r, k) == (doc, row, at + i):
                apart = None
            elif apart == (d, r, k - i):
                runs[-1][1] = i
            else:
                apart = d, r, k - i
                runs.append([i, i, d, r, k])
        w = words.split(b" ") if runs else ()
        out += [(b" ".join(w[a : b + WINDOW]), *place) for a, b, *place in runs]
    return out


PASSAGE = "seed long, shard int, salts int, words binary, doc long, row long, at int"


def passages(hot: DataFrame) -> DataFrame:
    """The confirmed passages of the units ``hot`` (of hot seeds), from their different units."""
    kinds = hot.groupBy("seed", "shard", "words").agg(F.count("*").alias("n"), F.first("salts").alias("salts"), F.min(F.struct("doc", "row", "at")).alias("p"))
    kinds = kinds.select("seed", "shard", "salts", "words", "p.*", "n").repartition("seed", "shard").sortWithinPartitions("seed", "shard")

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = (0, 0, 1), []

        def rows() -> pd.DataFrame:
            frame = pd.DataFrame([(*key, *p) for p in confirmed(held)] if held else [], columns=["seed", "shard", "salts", "words", "doc", "row", "at"])
            return frame.astype({"seed": "int64", "shard": "int32", "salts": "int32", "doc": "int64", "row": "int64", "at": "int32"})

        for pdf in batches:
            for seed, shard, salts, words, doc, row, at, n in pdf.itertuples(index=False, name=None):
                if (seed, shard, salts) != key:
                    yield rows()
                    key, held = (seed, shard, salts), []
                held.append((words, (doc, row, at), n))
        yield rows()

    return kinds.mapInPandas(found, PASSAGE)


def automaton_of(shard: list[tuple[bytes, int, int, int]]):
    """The automaton of passages (words, doc, row, at of the first place, the least of equal words);
    words have a space on either side, so only whole words match."""
    import ahocorasick

    first: dict[bytes, tuple[int, int, int]] = {}
    for words, *place in shard:
        first[words] = min(first.get(words, tuple(place)), tuple(place))
    a = ahocorasick.Automaton()
    for words, place in first.items():
        a.add_word(f" {words.decode('latin-1')} ", (len(words) + 2, words.count(b" ") + 2 - WINDOW, place))
    a.make_automaton()
    return a


def salted(known: DataFrame) -> DataFrame:
    """Passages of hot seeds, once for each task (``salt``) of their shard."""
    return known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))


def repeated_windows(cool: DataFrame, hot: DataFrame, known: DataFrame) -> DataFrame:
    """``row, at, n``: runs of n windows from window ``at`` on that earlier ones equal.

    In a task come, shard by shard: the passages ``known`` of hot seeds; the units
    ``cool``, which are held, HELD_UNITS of a seed at most, and confirmed; then the
    units ``hot``. All are in one automaton, and all units stream through it.
    """
    n = int(cool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = sum(x.agg(F.sum(F.length("words"))).first()[0] or 0 for x in (cool, known))
    shards = max(n, -(-size // SHARD_BYTES))
    bucket = F.pmod(F.xxhash64("seed", "shard"), F.lit(shards)).alias("bucket")
    columns = ("seed", "doc", "row", "at", "words")
    keys = salted(known).select(bucket, "salt", F.lit(0).alias("kind"), *columns)
    held = cool.select(bucket, F.lit(0).alias("salt"), F.lit(1).alias("kind"), *columns)
    rest = hot.select(bucket, F.pmod(F.xxhash64("row"), F.col("salts")).cast("int").alias("salt"), F.lit(2).alias("kind"), *columns)

    def located(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, compiled = None, False
        keys, units, automaton = [], [], None
        rows, ats, counts = [], [], []

        def stream(words: bytes, doc: int, row: int, at: int) -> None:
            text = f" {words.decode('latin-1')} "
            for end, (size, windows, first) in automaton.iter(text):
                here = at + text.count(" ", 0, end - size + 1)
                if first < (doc, row, here):
                    rows.append(row)
                    ats.append(here)
                    counts.append(windows)

        def close() -> None:
            """Compile the shard's passages, those of the held units too, and stream the latter."""
            nonlocal automaton, compiled
            compiled = True
            by_seed: dict[int, dict[bytes, list]] = {}
            for seed, words, *place in units:
                kinds, place = by_seed.setdefault(seed, {}), tuple(place)
                if (kind := kinds.get(words)) is None:
                    kinds[words] = [place, 1]
                else:
                    kind[:] = min(kind[0], place), kind[1] + 1
            for kinds in by_seed.values():
                keys.extend(confirmed([(words, *x) for words, x in kinds.items()]))
            automaton = automaton_of(keys) if keys else None
            if automaton:
                for _, *unit in units:
                    stream(*unit)

        for pdf in batches:
            for bucket, salt, kind, seed, doc, row, at, words in pdf.itertuples(index=False, name=None):
                if (bucket, salt) != key:
                    if key is not None and not compiled:
                        close()
                    key, compiled = (bucket, salt), False
                    keys, units, automaton = [], [], None
                if kind == 0:
                    keys.append((words, doc, row, at))
                elif kind == 1:
                    units.append((seed, words, doc, row, at))
                else:
                    if not compiled:
                        close()
                    if automaton:
                        stream(words, doc, row, at)
            yield pd.DataFrame({"row": np.array(rows, np.int64), "at": np.array(ats, np.int32), "n": np.array(counts, np.int32)})
            rows, ats, counts = [], [], []
        if key is not None and not compiled:
            close()
        yield pd.DataFrame({"row": np.array(rows, np.int64), "at": np.array(ats, np.int32), "n": np.array(counts, np.int32)})

    dealt = keys.unionByName(held).unionByName(rest).repartition(n, "bucket", "salt").sortWithinPartitions("bucket", "salt", "kind")
    return dealt.mapInPandas(located, "row long, at int, n int")


def merged_runs(runs: DataFrame) -> DataFrame:
    """``row, spans``: each row's word spans (start, end, start, end, ...) of touching runs joined."""

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for runs_of in pdf["runs"]:
                spans: list[int] = []
                for at, n in sorted((r["at"], r["n"]) for r in runs_of):
                    if spans and at <= spans[-1]:
                        spans[-1] = max(spans[-1], at + n + WINDOW - 1)
                    else:
                        spans += [at, at + n + WINDOW - 1]
                out.append(spans)
            yield pd.DataFrame({"row": pdf["row"], "spans": out})

    return runs.groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("runs")).mapInPandas(joined, "row long, spans array<int>")


def small(found: DataFrame, numbers: str) -> DataFrame:
    """``found`` (a read table of ``row`` and a column of int arrays), to be broadcast if it is measured to be small."""
    rows, cells = found.agg(F.count("*"), F.coalesce(F.sum(F.size(numbers)), F.lit(0))).first()
    return F.broadcast(found) if 48 * rows + 5 * cells <= BROADCAST_BYTES else found


def removals(rows: DataFrame, seeded: DataFrame) -> DataFrame:
    """``row, spans`` of the words to remove in every row of ``rows(row, doc_id, text)`` that has some; ``seeded`` is its ``seeds``, written."""
    places = seeded.select("row", F.posexplode("seeds").alias("place", "seed"))
    often = written(places.groupBy("seed").agg(F.count("*").alias("times")).where("times > 1").select("seed", "times", F.ceil(F.col("times") / HELD_UNITS).cast("int").alias("salts")), "seed-counts")
    total = often.agg(F.sum("times")).first()[0] or 0
    # fewer than MOST_HOT seeds; their places stay where their documents are
    most = F.broadcast(often.where(F.col("times") > max(HELD_UNITS, total // MOST_HOT)).select("seed", "salts"))
    known = places.join(most, "seed", "left_anti").join(often.select("seed", "salts"), "seed").unionByName(places.join(most, "seed"))
    place = F.when(F.col("salts") > 1, -1 - F.col("place")).otherwise(F.col("place"))
    recurring = written(known.groupBy("row").agg(F.collect_set(place).alias("places")), "recurring-seeds")
    found = written(units(rows.join(small(recurring, "places"), "row")), "units")
    kinds = found.where("hot").groupBy("seed").agg(F.approx_count_distinct("words").alias("kinds"))
    fewer = F.ceil(F.col("salts") * F.lit(HELD_UNITS) / F.greatest(F.lit(HELD_UNITS), F.coalesce("kinds", F.lit(0)) * UNITS_A_PASSAGE)).cast("int")
    salts = written(often.where("salts > 1").join(kinds, "seed", "left").select("seed", fewer.alias("salts")), "hot-seeds")
    salts = F.broadcast(salts) if salts.count() <= MOST_HOT else salts
    cool, hot = found.where("not hot").withColumn("shard", F.lit(0)), sharded(found.where("hot").drop("hot").join(salts, "seed"))
    return written(merged_runs(written(repeated_windows(cool, hot, written(passages(hot), "passages")), "repeated-windows")), "removals")


def with_rows(docs: DataFrame) -> DataFrame:
    """Rows are named by a hash of id and text. Null texts have no words, null ids come first."""
    return docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def without(rows: DataFrame) -> DataFrame:
    """``row, doc_id, n_words, n_removed, kept_text`` of ``rows(row, doc_id, text, spans)``."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n_words, gone, kept = [], [], []
            for text, spans in zip(pdf["text"], pdf["spans"]):
                w, left, at = ascii_words(text), [], 0
                for a, b in zip(spans[::2], spans[1::2]) if spans is not None else ():
                    left += w[at:a]
                    at = b
                left += w[at:]
                n_words.append(len(w))
                gone.append(len(w) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"row": pdf["row"], "doc_id": pdf["doc_id"].astype("Int64"), "n_words": n_words, "n_removed": gone, "kept_text": kept})

    return rows.select("row", "doc_id", "text", "spans").mapInPandas(cut, "row long, doc_id long, n_words long, n_removed long, kept_text string")


def dedup_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (words joined by one space) of every row of ``docs(doc_id, text)``.

    A word goes if a 20-word window over it also starts earlier: in a smaller
    doc_id, or earlier in the document.
    """
    rows = with_rows(docs)
    gone = removals(rows, written(seeds(rows), "seeds"))
    return without(rows.join(small(gone, "spans"), "row", "left")).drop("row")


def passage_digests(docs: DataFrame) -> DataFrame:
    """As ``dedup_passages`` with kept_sha256 in place of the text: only changed documents are read again."""
    rows = with_rows(docs)
    seeded = written(seeds(rows), "seeds")
    gone = removals(rows, seeded)
    changed = without(rows.join(small(gone, "spans"), "row")).select("row", "n_removed", F.sha2("kept_text", 256).alias("kept")).dropDuplicates(["row"])
    both = seeded.select("row", "doc_id", "n_words", "sha256").join(changed, "row", "left")
    return both.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept", "sha256").alias("kept_sha256"))


def op1_passages(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: null texts have no words, null ids come first, equal rows are judged as one."""
    return passage_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
