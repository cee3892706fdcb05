"""HTML extraction by consensus host paths.

1. Every page is cut into blocks, each within a container whose generalised path is made
   of tags and class names. A container's text is scored by letters: sentences and
   headings for it, link lists against it, the page's frame (menus, headers, footers)
   against what holds the frame.
2. Pages vote in Spark, each with one weight: scores are summed by host and path; those of
   paths that most pages have are handed on to the paths above. A container that says the same on three or more pages
   of a host, of which others differ, is no article and has no vote. The host's winners
   are its best paths none of which holds another.
3. Each page is extracted again with its host's winning paths: the text of the elements
   at the first one that the page has, in page order. A page that has none of them, or
   no host, takes its own best container.

The parser is a scan over tags with a stack of open elements: inline tags (an unclosed
``<b>`` too) do not nest, a paragraph ends where another block begins, an end tag closes
up to its own start or nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, table, written
from .urls import host_of

#: Winning paths of a host at most, for hosts with several templates, chosen from its PATHS_TRIED best; a page that has none of them takes its own best container.
PATHS_PER_HOST = 8
PATHS_TRIED = 64
#: A container with one text on so many pages of a host is no article.
SAME_ON_PAGES = 3
#: Factor for paths that are named as an article's.
NAMED = 1.2
#: Winners are broadcast up to this size, else joined by shuffle; those of hosts with a larger share than 1 / MOST_HOT of all pages always are broadcast.
BROADCAST_BYTES = 32 << 20
MOST_HOT = 1_000

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe object svg math canvas audio video select datalist noframes xmp".split())
CONTAINERS = frozenset("article main section div td th body form header footer nav aside center details blockquote figure fieldset dialog menu".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address figcaption caption summary ul ol dl table tr tbody thead tfoot legend hgroup option".split())
_NESTING = CONTAINERS | BLOCKS
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an element ends when it begins, and what bounds the search for that.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "ul")}
#: Elements and roles that are not the article.
LEFT_OUT = frozenset("nav footer aside form dialog menu button".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
FRAME = ("nav", "footer", "header")
# Words of class and id names that label what is not the article, that say that a name is of something else, and that name an article.
COMMENTS = frozenset("comment comments commentlist respond replies disqus discussion".split())
LABELS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promoted promotion outbrain taboola "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup paywall alert toast disclaimer "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc sidebar sidebars widget widgets related recommended recommendations share sharing social toolbar masthead topbar "
    "skip login search form footer footers copyright".split()
)
NO_LABEL = frozenset("with without has no not".split())
ARTICLE_NAME = r"(?i)^(article|main)\b|[.#-](article|content|post|entry|story|main|text|body)\b"

_NAME_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_REST = r"(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^>]*+"
_TAG = re.compile(rf"<(?:!--(?:.*?-->|.*)|[!?][^>]*+>?|((?i:{'|'.join(sorted(RAW))}))(?![^\s/>])(?:{_REST})>?.*?(?:</(?i:\1)(?![^\s/>])[^>]*+>?|\Z)|(/?)([a-zA-Z][^\s/>]*+)({_REST})>?)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_TELLS = re.compile(r"(?i)class|id|hidden|style|role")
_ARTICLE_NAME = re.compile(ARTICLE_NAME)
_END_MARKS = tuple(".!?:;…。！？\"'”’»)")


class Block(NamedTuple):
    """A stretch of text: its container's path, its tag, its text with one space for white space, the letters of it in links, why it is left out (empty if not)."""

    path: str
    tag: str
    text: str
    linked: int
    out: str


class _Open(NamedTuple):
    tag: str
    path: str
    out: str
    headings: bool  # only headings of it are kept


def name_words(names: str) -> list[set[str]]:
    """The lower-case words of each class or id name, cut at marks, digits and capitals."""
    return [{w.lower() for w in _NAME_WORD.findall(n)} for n in names.split()]


def step_of(tag: str, attributes: dict[str, str]) -> str:
    """A path step: the tag with its sorted class names, or without one its id; a run of digits is one ``#``."""
    names = sorted(set(attributes.get("class", "").split()))
    step = tag + "".join("." + n for n in names) if names else tag + ("#" + attributes["id"].strip() if attributes.get("id", "").strip() else "")
    return re.sub(r"[\s>]", "", re.sub(r"\d+", "#", step))


def left_out(tag: str, attributes: dict[str, str]) -> str:
    """Why an element is no part of an article; empty if it may be."""
    if tag in ("body", "html"):
        return ""
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attributes.get("style", "")):
        return "hidden"
    names = [w for w in name_words(attributes.get("class", "") + " " + attributes.get("id", "")) if not w & NO_LABEL]
    if any(w & COMMENTS for w in names):
        return "comments"
    if tag in LEFT_OUT:
        return tag
    if tag == "header" or any("header" in w and (len(w) == 1 or w & {"site", "page", "global", "top"}) for w in names):
        return "header"
    if attributes.get("role", "").lower() in ROLES:
        return "role"
    return "label" if tag not in ("article", "main") and any(w & LABELS for w in names) else ""


@lru_cache(maxsize=10_000)
def described(tag: str, rest: str) -> tuple[str, str]:
    """The path step of a start tag with the attributes ``rest``, and why it is left out."""
    attributes = {a.lower(): x or y or z for a, x, y, z in _ATTRIBUTE.findall(rest)}
    return step_of(tag, attributes), left_out(tag, attributes)


class _Parser:
    def __init__(self) -> None:
        self.stack, self.blocks = [_Open("", "", "", False)], []
        self.pieces: list[str] = []
        self.linked, self.in_link = 0, False

    def say(self, text: str) -> None:
        if "&" in text:
            text = unescape(text)
        self.pieces.append(text)
        if self.in_link:
            self.linked += len(text.strip())

    def flush(self) -> None:
        """End the block that was said."""
        if self.pieces and (text := " ".join("".join(self.pieces).split())):
            top = self.stack[-1]
            tag = top.tag if top.tag in BLOCKS else ""
            if not top.headings or tag in HEADINGS:
                self.blocks.append(Block(top.path, tag, text, self.linked, top.out))
        self.pieces.clear()
        self.linked = 0

    def close(self, k: int) -> None:
        """Close the open elements from number k on."""
        self.flush()
        del self.stack[k:]
        self.in_link = False

    def find(self, tags, upto=()) -> int:
        """The number of the innermost open element with one of ``tags``, 0 if there is none within those of ``upto``."""
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                return k
            if self.stack[k].tag in upto:
                return 0
        return 0

    def begin(self, tag: str, rest: str) -> None:
        """A block or container begins."""
        step, out = described(tag, rest)
        if k := self.find(("p", *HEADINGS), CONTAINERS):
            self.close(k)
        if tag in CLOSES:
            like, upto = (x.split() for x in CLOSES[tag])
            if k := self.find(like, upto):
                self.close(k)
        self.flush()
        self.in_link = False
        if tag in ("article", "main") and self.stack[-1].out:
            k = next(i for i, x in enumerate(self.stack) if x.out)
            if not any(x.out in ("comments", "hidden", "aside") for x in self.stack[k:]):
                # an unclosed menu or advert, or a form around the page, does not hold the article
                del self.stack[k:]
        above = self.stack[-1]
        why = above.out or out
        headings = above.headings
        if why == "header" and not above.out and any(x.tag in ("article", "main") for x in self.stack):
            why, headings = "", True
        path = f"{above.path}>{step}" if tag in CONTAINERS and tag != "body" else above.path
        self.stack.append(_Open(tag, path, why, headings))


def parse(html: str) -> list[Block]:
    """The blocks of a page in order, those of left-out elements too."""
    p = _Parser()
    parts = _TAG.split(html)
    skipped, depth = "", 0  # a left-out inline element that is open
    for text, end, tag, rest in zip(parts[::5], parts[2::5], parts[3::5], parts[4::5]):
        if text and not skipped:
            p.say(text)
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in _NESTING
        if skipped:
            depth += (-1 if end else 1) if tag == skipped else 0
            if not block and depth:
                continue
            skipped = ""
            if not block:
                continue
        if end:
            if tag == "a":
                p.in_link = False
            elif block:
                k = p.find((tag,))
                p.close(k) if k else p.flush()
        elif block:
            p.begin(tag, rest)
        elif tag == "br":
            p.pieces.append(" ")
        elif tag == "hr":
            p.flush()
        elif tag not in VOID:
            if (tag in LEFT_OUT or _TELLS.search(rest)) and described(tag, rest)[1]:
                skipped, depth = tag, 1
            elif tag == "a":
                p.in_link = True
    if not skipped:
        p.say(parts[-1])
    p.flush()
    return p.blocks


def value_of(block: Block) -> int:
    """Letters that speak for (sentences, headings) or against (links, the page's frame) what holds the block; the rest is neutral."""
    n = len(block.text)
    if block.out:
        return -n if block.out in FRAME else 0
    if 2 * block.linked > n:
        return -n
    return n if n >= 80 or block.tag in HEADINGS or block.tag in ("p", "pre") or block.text.endswith(_END_MARKS) else 0


def own_scores(blocks: list[Block]) -> dict[str, int]:
    """The values of the blocks right in each container, by path; a left-out block counts for the path it has."""
    out: dict[str, int] = {}
    for b in blocks:
        if value := value_of(b):
            out[b.path] = out.get(b.path, 0) + value
    return out


def above(path: str) -> list[str]:
    """The path itself and all paths above it, up to the page's (empty)."""
    steps = path.split(">")
    return [">".join(steps[:k]) for k in range(1, len(steps) + 1)]


def best_path(own: dict[str, int]) -> str:
    """The container with the greatest score, what it holds counted; of equal ones the deepest, then the least path."""
    whole: dict[str, float] = {}
    for path, value in own.items():
        for p in above(path):
            whole[p] = whole.get(p, 0) + value
    named = {p: s * (NAMED if _ARTICLE_NAME.search(p.rsplit(">", 1)[-1]) else 1) for p, s in whole.items() if s > 0}
    return min(named, key=lambda p: (-named[p], -p.count(">"), p), default="")


def text_at(blocks: list[Block], path: str, same: frozenset[str] | set[str] = frozenset()) -> list[str]:
    """The texts of the blocks at and below ``path``, without those left out and those at and below paths of ``same``."""
    inner = path + ">"
    kept = [b for b in blocks if not b.out and (b.path == path or b.path.startswith(inner))]
    return [b.text for b in kept if same.isdisjoint(above(b.path))] if same else [b.text for b in kept]


def extract(html: str | None, winners: list[str], same: list[str]) -> str:
    """The page's main text: at the first of ``winners`` where it has some, else in its own best container."""
    blocks = parse(html) if html else []
    for path in winners:
        if lines := text_at(blocks, path, set(same)):
            return "\n".join(lines)
    return "\n".join(text_at(blocks, best_path(own_scores(blocks))))


def votes(pages: DataFrame) -> DataFrame:
    """``host, path, share, said``: what each page of ``pages(host, html)`` gives to its containers, in
    thousandths of all that speaks for any of them, and a hash of what they say themselves."""

    def voted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for host, html in zip(pdf["host"], pdf["html"]):
                blocks = parse(html) if html else []
                own = own_scores(blocks)
                most = sum(v for v in own.values() if v > 0)
                said: dict[str, xxhash.xxh64] = {}
                for b in blocks:
                    if not b.out:
                        said.setdefault(b.path, xxhash.xxh64()).update(b.text.encode("utf-8", "surrogatepass") + b"\n")
                for path in own.keys() | said.keys():
                    own_hash = said[path].intdigest() - (1 << 63) if path in said else 0
                    rows.append((host, path, round(1000 * own.get(path, 0) / most) if most else 0, own_hash))
            yield pd.DataFrame(rows, columns=["host", "path", "share", "said"]).astype({"share": "int64", "said": "int64"})

    return pages.select("host", "html").mapInPandas(voted, "host string, path string, share long, said long")


def _holds(outer: Column, inner: Column) -> Column:
    return (outer == inner) | F.startswith(inner, F.concat(outer, F.lit(">")))


def winning_paths(pages: DataFrame) -> DataFrame:
    """``host, pages, winners, same``: each host's winning paths, best first, and the containers that say the same on all pages.

    Votes are summed before anything is ranked, so a host with a third of all pages is as
    many rows as it has paths; they are whole numbers, so the order of tasks changes nothing.
    """
    held = pages.where("host <> ''")
    own = votes(held).groupBy("host", "path").agg(F.sum("share").alias("share"), F.min("said").alias("low"), F.max("said").alias("high"), F.count("*").alias("n"))
    same = (F.col("n") >= SAME_ON_PAGES) & (F.col("low") == F.col("high"))
    by_host = Window.partitionBy("host")
    others = F.max((~same & (F.col("share") > 0)).cast("int")).over(by_host) == 1
    counts = held.groupBy("host").agg(F.count("*").alias("pages"))
    own = own.withColumn("same", same & others & (F.col("path") != "")).join(counts, "host")
    steps = F.split("path", ">")
    up = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), ">"))
    up = F.when(2 * F.col("n") > F.col("pages"), up).otherwise(F.array("path"))
    paths = own.where("not same").select("host", "share", F.explode(up).alias("path")).groupBy("host", "path").agg(F.sum("share").alias("share")).where("share > 0")
    score = F.col("share") * F.when(F.element_at(F.split("path", ">"), -1).rlike(ARTICLE_NAME), NAMED).otherwise(1.0)
    rank = F.row_number().over(by_host.orderBy(F.desc(score), F.desc(F.size(F.split("path", ">"))), "path"))
    best = paths.withColumn("rank", rank).where(F.col("rank") <= PATHS_TRIED).groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda r: r["path"]).alias("best"))
    apart = lambda kept, p: F.when((F.size(kept) >= PATHS_PER_HOST) | F.exists(kept, lambda k: _holds(k, p) | _holds(p, k)), kept).otherwise(F.array_append(kept, p))
    winners = best.select("host", F.aggregate("best", F.array().cast("array<string>"), apart).alias("winners"))
    repeated = own.where("same").select("host", "path").join(winners, "host").where(F.exists("winners", lambda w: (w != F.col("path")) & _holds(w, F.col("path"))))
    repeated = repeated.groupBy("host").agg(F.array_sort(F.collect_list("path")).alias("same"))
    return winners.join(repeated, "host", "left").join(counts, "host").select("host", "pages", "winners", F.coalesce("same", F.array().cast("array<string>")).alias("same"))


def main_text(pages: DataFrame) -> DataFrame:
    """``pages(url, html)`` with ``text``, its main text; a ``text`` column of the caller is replaced, all others stay.

    Null and empty html has an empty text. Pages without a host (null url, no ``://``) vote for
    nothing and take their own best container. Equal rows have equal texts and a vote each.
    """
    given = [c for c in pages.columns if c.lower() != "text"]
    host, won, many = (free_name(n, pages) for n in ("_host", "_won", "_pages"))
    named = pages.withColumn(host, host_of(F.col("url").cast("string")))
    winners = written(winning_paths(named.select(F.col(host).alias("host"), F.col("html").cast("string").alias("html"))), "host-paths")
    letters = F.length(F.array_join(F.concat("winners", "same"), ",")) + F.length("host") + 64
    total, size = winners.agg(F.sum("pages"), F.sum(letters)).first()
    known = winners.select(F.col("host").alias(host), F.struct("winners", "same").alias(won), F.col("pages").alias(many))
    if (size or 0) <= BROADCAST_BYTES:
        met = named.join(F.broadcast(known), host, "left")
    else:
        hot = F.col(many) > (total or 0) // MOST_HOT  # fewer than MOST_HOT hosts: their pages stay where they are
        first = named.join(F.broadcast(known.where(hot)), host, "left")
        lone = F.col(won).isNull() & (F.col(host) != "")
        met = first.where(~lone).unionByName(first.where(lone).drop(won, many).join(known.where(~hot), host, "left"))

    def extracted(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        listed = lambda x: list(x) if x is not None else []
        for html, paths, same in batches:
            yield pd.Series([extract(h, listed(p), listed(s)) for h, p, s in zip(html, paths, same)], dtype=object)

    text = F.pandas_udf(extracted, "string")(F.col("html").cast("string"), F.col(f"{won}.winners"), F.col(f"{won}.same"))
    return met.withColumn("text", text).select(*given, "text")


def op13_html_text(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text and its code points of every row of ``pages``; null and empty html has an empty text."""
    found = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
