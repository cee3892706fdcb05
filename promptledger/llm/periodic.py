"""Periodic runs: a suffix automaton whose suffix-link tree is a link-cut tree.

A run is a stretch of words with smallest period q that repeats at least four times
(and has six words at least) and that no neighbouring word extends.

Each appended word makes the automaton's state of the whole prefix; access to it
recolours the path to the root with the word's place. The path falls into segments of
states that ended last at one place j; the segment's longest string, of L words, ends
at j and at the new place i. Where i - j <= L it is a square of period i - j, and the
stretch of L + i - j words that ends at i has that smallest period and cannot grow to
the left; it grows to the right as more words come.

Only stretches that may hold a run come to the automaton, found for many texts at
once: within a run of period q and length n, n - q - 2 successive word triples were
seen q words before at most. Triples that came again are kept, each with the distance
to the one before, as long as they stand in a row that is long enough for that
distance; what is left, with a period's words before it, holds every run whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .passages import CHUNK_BYTES, mixed, powers
from .shared import table

LEAST_WORDS = 6
LEAST_REPEATS = 4

_RANDOM = np.random.default_rng(12)
_LETTER = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_TRIPLE = (_RANDOM.integers(1, 1 << 63, 4, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


class LinkCutTree:
    """A rooted forest of paths with one colour each; nodes are numbers from 1, 0 is none.

    A path is a splay tree by depth. Its colour is kept at the splay tree's root, whose
    ``up`` is the node above the path's top.
    """

    def __init__(self) -> None:
        self.left, self.right, self.up, self.colour = [0], [0], [0], [-1]

    def add(self, above: int, colour: int) -> int:
        """A new path of one node below ``above``."""
        self.left.append(0)
        self.right.append(0)
        self.up.append(above)
        self.colour.append(colour)
        return len(self.up) - 1

    def _inner(self, x: int) -> bool:
        p = self.up[x]
        return p != 0 and (self.left[p] == x or self.right[p] == x)

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        p = up[x]
        g = up[p]
        if left[p] == x:
            left[p] = b = right[x]
            right[x] = p
        else:
            right[p] = b = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p], up[x] = x, g
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def splay(self, x: int) -> None:
        top = x
        while self._inner(top):
            top = self.up[top]
        self.colour[x] = self.colour[top]
        while self._inner(x):
            p = self.up[x]
            if self._inner(p):
                g = self.up[p]
                self._rotate(p if (self.left[g] == p) == (self.left[p] == x) else x)
            self._rotate(x)

    def insert_above(self, x: int, middle: int) -> None:
        """Put the new node ``middle``, below x's parent, between the two; colours stay."""
        self.splay(x)
        if above := self.left[x]:  # the path is cut over x
            self.left[x] = 0
            self.up[above] = self.up[x]
            self.colour[above] = self.colour[x]
        self.up[x] = middle

    def access(self, x: int, colour: int) -> list[tuple[int, int]]:
        """Make the path from x to the root one, of ``colour``; the colours it had and the deepest node of each, from x on."""
        found, below, u = [], 0, x
        while u:
            self.splay(u)
            found.append((self.colour[u], u))
            if cut := self.right[u]:
                self.colour[cut] = self.colour[u]
            self.right[u] = below
            below, u = u, self.up[u]
        self.splay(x)
        self.colour[x] = colour
        return found


def squares(word_ids: list[int]) -> dict[tuple[int, int], int]:
    """``(start, period): end`` of every run of LEAST_REPEATS periods and LEAST_WORDS words; end is exclusive."""
    tree = LinkCutTree()
    tree.add(0, -1)  # the root, node 1
    length, link, after = [0, 0], [0, 0], [{}, {}]
    out: dict[tuple[int, int], int] = {}
    last = 1
    for i, c in enumerate(word_ids):
        new, p = len(length), last
        length.append(length[last] + 1)
        after.append({})
        link.append(0)
        while p and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if not p:
            link[new] = 1
            tree.add(1, -1)
        else:
            q = after[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
                tree.add(q, -1)
            else:
                clone = new + 1
                length.append(length[p] + 1)
                after.append(after[q].copy())
                link.append(link[q])
                tree.splay(q)
                tree.add(clone, -1)
                tree.add(link[q], tree.colour[q])
                tree.insert_above(q, clone)
                link[q] = link[new] = clone
                while p and after[p].get(c) == q:
                    after[p][c] = clone
                    p = link[p]
        last, before = new, -1
        for j, node in tree.access(new, i):
            if j > before:  # of several paths of one colour the first has the longest string
                before, d, size = j, i - j, length[node]
                if d <= size and size + d >= LEAST_WORDS and size + d >= LEAST_REPEATS * d:
                    out[i - d - size + 1, d] = i + 1
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, and the number of its text."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    inside = np.concatenate([[False], ~_IS_SPACE[data], [False]])
    edges = np.nonzero(inside[1:] != inside[:-1])[0]
    starts, ends = edges[::2], edges[1::2]
    begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts]), np.searchsorted(begins, starts, "right") - 1


def stretches(codes: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """Word places ``a, b`` of stretches, each within one text and apart, that hold every run."""
    n = len(codes) - 2
    if n <= 0:
        return []
    whole = np.nonzero(owner[:n] == owner[2:])[0]
    triples = mixed(codes[whole] * _TRIPLE[0] + codes[whole + 1] * _TRIPLE[1] + codes[whole + 2] * _TRIPLE[2] + owner[whole].astype(np.uint64) * _TRIPLE[3])
    order = np.argsort(triples, kind="stable")
    again = np.nonzero(triples[order[1:]] == triples[order[:-1]])[0]
    at, was = whole[order[again + 1]], whole[order[again]]
    by_place = np.argsort(at)
    at, distance = at[by_place], (at - was)[by_place]
    while len(at):
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])])
        number = np.cumsum(new) - 1
        size = np.bincount(number)
        # a run of period q and n words has n - q - 2 such triples; n is 4 q at least, and 6
        keep = np.maximum((LEAST_REPEATS - 1) * distance - 2, LEAST_WORDS - 3) <= size[number]
        if keep.all():
            break
        at, distance = at[keep], distance[keep]
    if not len(at):
        return []
    first, most = np.nonzero(new)[0], (size + 2) // (LEAST_REPEATS - 1)
    text_begins = np.searchsorted(owner, owner[at[first]])
    a, b = np.maximum(at[first] - most, text_begins), at[first] + size + 2
    out: list[tuple[int, int]] = []
    for lo, hi in zip(a.tolist(), b.tolist()):
        if out and lo < out[-1][1] and owner[lo] == owner[out[-1][0]]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def runs_in(texts: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
    """The runs (start, length, period), by start, then period, of the texts that have some, by the text's number."""
    codes, owner = word_hashes(texts)
    out: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in stretches(codes, owner):
        ids = np.unique(codes[a:b], return_inverse=True)[1].tolist()
        base = int(np.searchsorted(owner, owner[a]))
        found = [(a - base + start, end - start, q) for (start, q), end in squares(ids).items()]
        if found:
            out.setdefault(int(owner[a]), []).extend(found)
    return {k: sorted(v, key=lambda r: (r[0], r[2])) for k, v in out.items()}


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run holds after its first period."""
    dropped = bytearray(len(words))
    for start, length, period in runs:
        dropped[start + period : start + length] = b"\x01" * (length - period)
    return [w for w, gone in zip(words, dropped) if not gone]


RUNS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_text binary"


def periodic_runs(docs: DataFrame, altered: Callable[[str, bytes], bytes] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed_text of every row of ``docs(doc_id, text)``.

    Words are stretches without ASCII white space, numbered from 0. The collapsed text has
    the words that no run holds after its first period, joined by one space. Null and empty
    texts have no words and no runs; equal rows, and rows without an id, are judged alike.
    ``altered`` makes the text that is judged from the id (as text, empty if null) and the row's.
    """

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, texts = pdf["doc_id"].astype("Int64"), [t or b"" for t in pdf["text"]]
            if altered:
                texts = [altered("" if i is pd.NA else str(i), t) for i, t in zip(ids, texts)]
            a = size = 0
            for b, t in enumerate(texts, 1):
                size += len(t)
                if size < CHUNK_BYTES and b < len(texts):
                    continue
                runs = runs_in(texts[a:b])
                n_words, kept, listed = [], [], []
                for k, t in enumerate(texts[a:b]):
                    words, own = t.split(), runs.get(k, [])
                    n_words.append(len(words))
                    kept.append(b" ".join(without_repeats(words, own) if own else words))
                    listed.append([dict(zip(("start", "length", "period"), r)) for r in own])
                yield pd.DataFrame({"doc_id": ids[a:b].reset_index(drop=True), "n_words": n_words, "runs": listed, "collapsed_text": kept})
                a, size = b, 0

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInPandas(found, "doc_id long, " + RUNS).withColumn("collapsed_text", F.col("collapsed_text").cast("string"))


def tail_repeated(doc_id: str, text: bytes) -> bytes:
    """The text as the query judges it: of a tenth of the ids, the words from some place on are repeated."""
    h = crc32(doc_id.encode())
    if not doc_id or h % 10 or not (words := text.split()):
        return text
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)])


def digest(found: DataFrame) -> DataFrame:
    """The numbers and hashes of ``periodic_runs``, one row each."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    told: Column = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.withColumn("_best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.expr("(1000 * _best.length) div (-_best.period)").alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, of which a tenth is altered by its id to hold runs.

    Null and empty texts have no runs and the hash of an empty text; rows without an id are not altered; equal rows have equal results.
    """
    return digest(periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), tail_repeated))
