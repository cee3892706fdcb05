"""MinHash near-duplicates: DartMinHash signatures, banded joins, exact verification.

A document is the multiset of its five-word shingles (lower-case ``\\w+`` words;
one to four words make one shingle). Each shingle with weight w owns the region
[0, w) x ranks; hashed darts fall on it at unit rate, the same for every document,
and each signature coordinate keeps its earliest dart. Documents with the same
words are one node. Nodes that share a band are compared exactly: weighted
Jaccard similarity of 0.8 or more makes a link, linked nodes a class.

No pairs are listed within a bucket of copies: every bucket's members are compared
with one centre (a star). A member x that is then in another class than its centre c
is told apart by x ^ c, what it has beside c and lacks of it: two members differ in
(x ^ c) ^ (y ^ c), so a pair that is near shares one of the first elements of both
(beside c before lacking, then by hash) and meets in that element's bucket. Pages of
one template with texts of their own meet nowhere. What sets c itself apart is in every
x ^ c, so a large star takes the member nearest to what most are for centre. A bucket that many share is a
star with a new centre at the next level; bounds from above drop pairs of the others
before the exact comparison. No pair that shares a band is lost to any of this.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import joined_roots
from .shared import free_name, table, written

SHINGLE_WORDS = 5
SIMILARITY = 0.8
COORDINATES = 96
BAND_ROWS = 4  # 24 bands: a pair at 0.8 shares none with probability 3e-6
#: 64-bit words of the bitmaps of elements that only a member, and only its centre, has.
BITMAP_WORDS = 16
#: Members of a bucket beyond which they are compared with a new centre, and that one salt takes at the last level.
HOT_MEMBERS = 256
#: Stars upon stars; what is still hot at the last level is joined within its bucket.
LEVELS = 3
#: A pair at SIMILARITY or more differs in at most this share of its sizes' sum.
UNLIKE = (1 - SIMILARITY) / (1 + SIMILARITY)
#: Elements whose darts are thrown at once.
BATCH_ELEMENTS = 40_000
MAX_REMEMBERED = 500_000

WORD = re.compile(r"\w+")
MASK = (1 << 64) - 1
_BASE = -7  # the first rank band is [0, 2**_BASE), each further one doubles the edge
_MIX = (np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


@lru_cache(maxsize=64)
def dart_counts(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts in a region of this area."""
    p, out, k = np.exp(-mean), [], 0
    total = p
    while total < 1 - 1e-13 and k < 10 * mean + 60:
        out.append(total)
        k += 1
        p *= mean / k
        total += p
    return np.array(out)


def dart_signatures(arrays: list[np.ndarray], weights: list[np.ndarray] | None = None) -> np.ndarray:
    """Earliest dart of every coordinate for each document of a batch.

    ``arrays`` are 64-bit element hashes, none empty; weights are positive (1 each if None).
    """
    sizes = np.array([len(a) for a in arrays])
    cells, doc, left = np.concatenate(arrays), np.repeat(np.arange(len(arrays)), sizes), None
    if weights is not None:
        w = np.concatenate(weights)
        slices = np.ceil(w).astype(np.int64)
        at = np.repeat(np.arange(len(cells)), slices)
        number = np.arange(len(at)) - np.repeat(np.cumsum(slices) - slices, slices)
        cells, doc, left = mixed(cells[at] + number.astype(np.uint64) * _MIX[0]), doc[at], w[at] - number
    signature = np.zeros(len(arrays) * COORDINATES, np.uint64)
    empty = np.ones(len(arrays) * COORDINATES, bool)
    band = 0
    while len(cells):
        low, high = (0.0 if band == 0 else 2.0 ** (_BASE + band - 1)), 2.0 ** (_BASE + band)
        cdf = dart_counts(high - low)
        shift = np.uint64((band + 1) * int(_MIX[1]) & MASK)
        u = uniform(mixed(cells + shift))
        hit = np.nonzero(u >= cdf[0])[0]
        many = np.searchsorted(cdf, u[hit], "right")
        own = np.repeat(hit, many)
        order = (np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)).astype(np.uint64)
        dart = mixed(cells[own] + shift + (order + np.uint64(1)) * _MIX[2])
        if left is not None:
            inside = uniform(mixed(dart + _MIX[4])) < left[own]
            dart, own = dart[inside], own[inside]
        slot = doc[own] * COORDINATES + (dart % np.uint64(COORDINATES)).astype(np.int64)
        wanted = empty[slot]
        dart, slot = dart[wanted], slot[wanted]
        last_first = np.argsort(mixed(dart + _MIX[5]))[::-1]  # the darts' ranks within the band
        signature[slot[last_first]] = dart[last_first]
        empty[slot] = False
        open_ = empty.reshape(-1, COORDINATES).any(1)
        if not open_.all():
            keep = open_[doc]
            cells, doc, left = cells[keep], doc[keep], None if left is None else left[keep]
        band += 1
    return signature.reshape(-1, COORDINATES)


class Shingler:
    """Texts to element hashes: a shingle's k-th occurrence is an element of weight 1."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def words(self, text: str | None) -> list[str]:
        return WORD.findall(text.lower()) if text else []

    def elements(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > MAX_REMEMBERED:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(SHINGLE_WORDS, len(codes))
        n = len(codes) - size + 1
        h = np.full(n, size, np.uint64)
        for k in range(size):
            h += codes[k : k + n] * _MIX[8 + k]
        h = np.sort(mixed(h))
        first = np.concatenate([[True], h[1:] != h[:-1]])
        if first.all():
            return mixed(h)
        at = np.arange(n)
        return mixed(h + (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64) * _MIX[7])


def word_key(words: list[str]) -> bytes:
    return blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def text_row(doc_id: Column, text: Column) -> Column:
    """A number for a row's id and text; rows of one id are told apart by it."""
    return F.xxhash64(doc_id.cast("long"), text.cast("string"))


def band_hashes(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(-1, BAND_ROWS)
    h = np.arange(1, len(rows) + 1, dtype=np.uint64) * _MIX[20]
    for r in range(BAND_ROWS):
        h = mixed(h + rows[:, r] * _MIX[21 + r])
    return h.astype(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, row, key, n, bands of ``docs(doc_id, text)``; texts without words have no bands and a key of the text."""

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Shingler()

        def frame(ids: list, numbers: list, keys: list[bytes], elements: list[np.ndarray]) -> pd.DataFrame:
            none = np.zeros(0, np.int64)
            some = [e for e in elements if len(e)]
            found = iter(dart_signatures(some) if some else ())
            bands = [band_hashes(next(found)) if len(e) else none for e in elements]
            return pd.DataFrame({"doc_id": ids, "row": numbers, "key": keys, "n": [len(e) for e in elements], "bands": bands})

        for pdf in batches:
            ids, numbers, keys, elements, held = [], [], [], [], 0
            for doc_id, number, text in zip(pdf["doc_id"].tolist(), pdf["row"].tolist(), pdf["text"]):
                words = s.words(text)
                ids.append(doc_id)
                numbers.append(number)
                keys.append(word_key(words or ["", text or ""]))
                elements.append(s.elements(words))
                held += len(elements[-1])
                if held > BATCH_ELEMENTS:
                    yield frame(ids, numbers, keys, elements)
                    ids, numbers, keys, elements, held = [], [], [], [], 0
            if ids:
                yield frame(ids, numbers, keys, elements)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_row(F.col("doc_id"), F.col("text")).alias("row")).where("doc_id is not null")
    return rows.mapInPandas(signed, "doc_id long, row long, key binary, n long, bands array<long>")


def elements_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, elements`` of the nodes ``wanted(node, key, doc_id, row)``, from their documents' texts.

    The texts are sent to ``wanted``, whatever its size, so disk and memory grow with the input only.
    Equal rows meet there, and one of them is shingled.
    """

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Shingler()
        for pdf in batches:
            words = [s.words(t) for t in pdf["text"]]
            own = [bytes(k) == word_key(w) for k, w in zip(pdf["key"], words)]  # another text may have the row's number
            yield pd.DataFrame({"node": pdf["node"][own], "elements": [s.elements(w).astype(np.int64) for w, ok in zip(words, own) if ok]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_row(F.col("doc_id"), F.col("text")).alias("row"))
    texts = rows.join(wanted.hint("shuffle_hash"), ["doc_id", "row"]).dropDuplicates(["doc_id", "row"])
    return texts.select("node", "key", "text").mapInPandas(listed, "node long, elements array<long>")


def bitmap(elements: Column) -> Column:
    """BITMAP_WORDS 64-bit words; every element sets one bit."""
    one = F.lit(1).cast("long")
    own = lambda w: F.filter(elements, lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(BITMAP_WORDS - 1)) == w)
    word = lambda w: F.aggregate(own(w), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(F.call_function("shiftleft", one, x.bitwiseAND(F.lit(63)).cast("int"))))
    return F.transform(F.sequence(F.lit(0), F.lit(BITMAP_WORDS - 1)), word)


def compared(shingles: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(a, b)``, of nodes of ``shingles(node, elements)``, with the sizes ``na, nb``, ``both`` (the size of the multisets' overlap),
    ``close`` (a link), bitmaps of the elements that only ``a`` (``rest``) and only ``b`` (``miss``) has, and
    the ``first`` of both, in 32 bits: as many as ``a`` can differ in from a near text, and one.

    Elements are unique within a document, so the overlap is the size of an array
    intersection. ``b`` may be the same for very many pairs: its elements are joined
    to bare numbers first, then the pairs are dealt by ``a``.
    """
    a = shingles.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    b = shingles.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    met = pairs.join(b, "b").join(a, "a").select("a", "b", F.size("ea").alias("na"), F.size("eb").alias("nb"), F.array_except("ea", "eb").alias("oa"), F.array_except("eb", "ea").alias("ob"))
    met = met.withColumn("both", F.col("na") - F.size("oa"))
    close = F.col("both") >= SIMILARITY * (F.col("na") + F.col("nb") - F.col("both"))
    most = (F.floor(F.col("na") * (1 - SIMILARITY) / SIMILARITY + 1e-6) + 1).cast("int")
    first = F.transform(F.slice(F.concat(F.array_sort("oa"), F.array_sort("ob")), F.lit(1), most), lambda e: F.shiftright(e, 32).cast("int"))
    return written(met.select("a", "b", "na", "nb", "both", close.alias("close"), bitmap(F.col("oa")).alias("rest"), bitmap(F.col("ob")).alias("miss"), first.alias("first")), "near-met")


def ends(pairs: DataFrame) -> DataFrame:
    """Each ``node`` of ``pairs(a, b)`` once."""
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _long_enough(n: str, m: str):
    return (F.col(n) >= SIMILARITY * F.col(m)) & (F.col(m) >= SIMILARITY * F.col(n))


def classed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, row, key and root (a number of its class) of every row of ``docs(doc_id, text)`` that has an id.

    Equal texts without words are one class. First every bucket's members are compared
    with a centre, the member that shares most buckets with most others (a text that
    many copies were made from); those left in another class than it go ``across``,
    which names centres for a next level where many still meet.
    """
    signed = written(signatures(docs), "near-signatures")
    nodes = signed.groupBy("key").agg(F.min(F.struct("doc_id", "row")).alias("of"), F.first("bands").alias("bands"))
    nodes = written(nodes.select("key", "of.*", "bands").withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    members = nodes.select("node", F.explode("bands").alias("h"))
    busy = members.groupBy("h").agg(F.count("*").alias("size")).where("size > 1")
    members = written(members.join(busy, "h"), "near-members")
    met = members.join(members.groupBy("node").agg(F.sum("size").alias("met")), "node")
    centres = met.groupBy("h").agg(F.max(F.struct("met", "node"))["node"].alias("centre"))
    pairs = members.join(centres, "h").where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    pairs = written(pairs, "near-pairs")
    # texts are read and sent once: the pairs of all further levels are of the same nodes
    shingles = written(elements_of(docs, nodes.join(ends(pairs), "node").select("node", "key", "doc_id", "row")), "near-elements")
    roots = None
    for level in range(LEVELS):
        star = compared(shingles, pairs)
        roots = joined_roots(roots, star.where("close").select("a", "b"), "near-roots")
        moved = nearer_centres(star)
        if not moved.isEmpty():
            kept, again = recentred(star, moved)
            again = compared(shingles, again)
            roots = joined_roots(roots, again.where("close").select("a", "b"), "near-roots")
            star = kept.union(again)
        rest, pairs = across(star, roots, last=level == LEVELS - 1)
        left = rest if pairs is None else rest.union(pairs)
        if left.isEmpty():
            break
        # all that is compared from now on is of the nodes of these pairs, so only their shingles are sent again
        shingles = written(shingles.join(ends(left), "node", "left_semi"), "near-left")
        if not rest.isEmpty():
            links = compared(shingles, rest).where("close").select("a", "b")
            roots = joined_roots(roots, links, "near-roots")
        if pairs is None or pairs.isEmpty():
            break
    classed = signed.select("doc_id", "row", "key").join(nodes.select("key", "node"), "key").join(roots, "node", "left")
    return classed.select("doc_id", "row", "key", F.coalesce("root", "node").alias("root"))


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) of every row of ``docs(doc_id, text)`` that has an id."""
    classed = classed_rows(docs)
    names = classed.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return classed.join(names, "root").select("doc_id", "class_id")


def nearer_centres(star: DataFrame) -> DataFrame:
    """``b, head`` of stars that may fill a hot bucket and whose centre is an outlier: ``head`` is the member nearest to what most are.

    What more than half of the members have beside the centre ``b``, or lack of it, is the
    centre's own difference from them: all would share it, and meet in the bucket of each
    of its elements. A head is named where it differs in less from what most have.
    """
    large = star.groupBy("b").agg(F.count("*").alias("size")).where(F.col("size") > HOT_MEMBERS)
    each = star.join(large, "b").select("b", "size", F.explode(F.array_distinct("first")).alias("e"))
    usual = each.groupBy("b", "e").agg(F.count("*").alias("many"), F.first("size").alias("size")).where("2 * many > size").groupBy("b").agg(F.collect_list("e").alias("usual"))
    differs = F.col("na") + F.col("nb") - 2 * F.col("both") + F.size("usual") - 2 * F.size(F.array_intersect("first", "usual"))
    nearest = star.join(usual, "b").groupBy("b").agg(F.min(F.struct(differs.alias("differs"), F.col("a").alias("head"))).alias("least"), F.first(F.size("usual")).alias("own"))
    return written(nearest.where("least.differs < own").select("b", "least.head"), "near-heads")


def recentred(star: DataFrame, moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``star`` whose centre stays, and the pairs ``a, b`` of all nodes of the other stars with their new centre, without the rows' pairs."""
    kept = star.join(moved, "b", "left_anti").select(star.columns)
    nodes = star.join(moved, "b").select("a", "head").union(moved.select("b", "head")).where("a <> head").select("a", F.col("head").alias("b")).distinct()
    return kept, written(nodes.join(kept.select("a", "b"), ["a", "b"], "left_anti"), "near-pairs")


def first_elements(star: DataFrame, roots: DataFrame) -> DataFrame:
    """``star``'s members with their class, of centres that have one in another class and two at least.

    ``short`` is how many of ``first`` can be without the other's element if that differs
    from the centre in no less: half of what the two differ in. Where the member is in the
    centre's class the other is not, so it differs from the centre in more than UNLIKE allows.
    """
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
    own, lacks = F.col("na") - F.col("both"), F.col("nb") - F.col("both")
    apart = F.coalesce("ra", "a") != F.coalesce("rb", "b")
    half = F.col("na") * (1 - SIMILARITY) / SIMILARITY / 2
    inside = (own + lacks + UNLIKE * (F.col("na") - F.col("nb"))) / 2
    short = F.floor(F.when(apart, half).otherwise(F.greatest(F.least(half, inside), F.lit(0.0))) + 1e-6) + 1
    cells = star.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.col("a").alias("node"), F.col("b").alias("centre"), F.coalesce("ra", "a").alias("root"), apart.alias("apart"),
        F.col("na").alias("n"), "both", own.alias("own"), lacks.alias("lacks"), "rest", "miss", "first", short.alias("short"),
    )
    cells = written(cells, "near-cells")
    open_ = cells.groupBy("centre").agg(F.count_if("apart").alias("aparts"), F.count("*").alias("size")).where("aparts > 0 and size > 1")
    return cells.join(open_.select("centre"), "centre", "left_semi")


def across(star: DataFrame, roots: DataFrame, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Pairs ``a, b`` of members of one centre and of two classes, one of them not the centre's, that may be
    links; and, but at the ``last`` level, pairs of a member and a new centre for the buckets that many share.

    ``star`` is how members met the centre c. x and y share |c| less what x lacks,
    less what y lacks, plus what both lack, of c, and beside c what both have; bitmaps
    bound the latter two from above. A near pair has one element of x ^ c and y ^ c in
    common at least (if none, they differ in all of both, more than UNLIKE allows), and
    the least such is among the ``short`` ones of that which differs less from c, and
    the ``first`` ones of the other.
    """
    cells = first_elements(star, roots)
    named = ("node", "root", "apart", "n", "both", "own", "lacks")
    keys = cells.select("centre", *named, "short", F.posexplode("first").alias("at", "e")).withColumn("short", F.col("at") < F.col("short")).drop("at")
    busy = keys.groupBy("centre", "e").agg(F.count_if("short").alias("shorts"), F.count_if("apart").alias("aparts"), F.count("*").alias("size")).where("shorts > 0 and aparts > 0 and size > 1")
    keys = written(keys.join(busy.select("centre", "e", "shorts"), ["centre", "e"]), "near-keys")
    further = None
    if not last:
        hot = keys.where(F.col("shorts") > HOT_MEMBERS)
        heads = hot.groupBy("centre", "e").agg(F.max(F.struct(F.xxhash64("node"), "node"))["node"].alias("head"))  # one for buckets of the same members
        further = written(hot.join(heads, ["centre", "e"]).where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), "near-pairs")
        keys = keys.where(F.col("shorts") <= HOT_MEMBERS)
    ones = lambda bits: F.aggregate(bits, F.lit(0), lambda s, x: s + F.bit_count(x))
    known = cells.select("centre", "node", F.concat("rest", "miss").alias("bits"), (F.col("own") - ones("rest")).alias("xown"), (F.col("lacks") - ones("miss")).alias("xlacks"))
    keys = keys.join(known, ["centre", "node"])
    named += ("bits", "xown", "xlacks")
    salts = F.ceil(F.col("shorts") / HOT_MEMBERS).cast("int")
    left = keys.where("short").withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int"))
    right = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    a, b = (side.select(*[F.col(c).alias(c + x) for c in ("centre", "e", "salt", *named)]) for side, x in ((left, "a"), (right, "b")))
    less = lambda c: F.least(F.col(f"{c}a"), F.col(f"{c}b"))
    enough = lambda shared: (F.col("botha") - F.col("lacksb") + shared) * (1 + SIMILARITY) >= SIMILARITY * (F.col("na") + F.col("nb")) - 1e-6
    # common bits, and the elements that share a bit with others of their set
    bits = F.aggregate(F.zip_with("bitsa", "bitsb", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, k: s + k)
    fewer = F.col("owna") + F.col("lacksa") <= F.col("ownb") + F.col("lacksb")
    near = fewer & (F.col("nodea") != F.col("nodeb")) & (F.col("aparta") | F.col("apartb")) & (F.col("roota") != F.col("rootb")) & _long_enough("na", "nb")
    near = near & enough(less("own") + less("lacks")) & enough(bits + less("xown") + less("xlacks"))
    met = a.join(b, (F.col("centrea") == F.col("centreb")) & (F.col("ea") == F.col("eb")) & (F.col("salta") == F.col("saltb")) & near)
    return written(met.select(F.least("nodea", "nodeb").alias("a"), F.greatest("nodea", "nodeb").alias("b")).distinct(), "near-rest"), further


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: that of the least id, and of the least key and number
    where the id has several texts; rows without an id stay."""
    own = [free_name("_id", docs), free_name("_row", docs)]
    first = classed_rows(docs).groupBy("root").agg(F.min(F.struct("doc_id", "key", "row")).alias("f")).select(F.col("f.doc_id").alias(own[0]), F.col("f.row").alias(own[1]))
    named = docs.withColumns({own[0]: F.col("doc_id").cast("long"), own[1]: text_row(F.col("doc_id"), F.col("text"))})
    kept = named.join(first, own, "left_semi").dropDuplicates(own)
    return kept.select(docs.columns).union(docs.where("doc_id is null"))


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """doc_id, class_id and whether it is kept, of every row of ``documents``.

    Texts without words (null and empty ones too) are one class each with their equals;
    rows without an id have no class and are kept.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    classes = near_classes(docs)
    unnamed = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return classes.union(unnamed).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
