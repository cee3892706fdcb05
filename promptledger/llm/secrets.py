"""Secret scans: an Aho-Corasick automaton finds keywords, regular expressions run
anchored at its hits only, and tokens with an embedded checksum are verified.

Runs of hexadecimal digits have no keyword; one pattern finds them directly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table

#: Kinds in the order in which equal starts are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "github", "npm")
#: Keywords and the kind that each may begin.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
}
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
LEAST = {"assign": 6, "access": 20}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, k = divmod(n, 62)
        out = DIGITS[k] + out
    return out.rjust(width, "0")


def checksum_holds(body: str, check: str) -> bool:
    """The last six characters are the base-62 CRC-32 of those before."""
    return base62(crc32(body.encode()), 6) == check


@lru_cache(maxsize=1)
def keyword_automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def lowered(text: str) -> str:
    """Lower case, character by character: offsets stay those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, by start, then kind; a null text has none."""
    if not text:
        return []
    spans = [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    after = dict.fromkeys(KINDS, 0)
    starts = sorted((end - n + 1, kind) for end, (n, kind) in keyword_automaton().iter(lowered(text)))
    for start, kind in starts:
        if start < after[kind]:
            continue
        if kind in LEAST:
            if m := (_ASSIGN if kind == "assign" else _ACCESS).match(text, start):
                after[kind] = m.end()
                if len(m[1] if kind == "assign" else m[0]) >= LEAST[kind]:
                    spans.append((start, m.end(), kind))
        elif (m := (_GITHUB if kind == "github" else _NPM).match(text, start)) and checksum_holds(m[1], m[2]):
            after[kind] = m.end()
            spans.append((start, m.end(), kind))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every stretch of secrets replaced by ``[secret]``."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, into: str = "secrets") -> DataFrame:
    """``docs`` with ``into`` (in place of a column of that name), an array of (start, end, kind) in code points.

    Null and empty texts have none; every row stays.
    """

    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"start": a, "end": b, "kind": k} for a, b, k in find_secrets(t)] for t in texts])

    return docs.withColumn(into, F.pandas_udf(scanned, "array<struct<start: long, end: long, kind: string>>")(F.col("text").cast("string")))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets replaced in ``text`` (and ``n_chars`` counted again); every row stays."""

    def replaced(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([redacted(t, s) if t and (s := find_secrets(t)) else t for t in texts])

    out = docs.withColumn("text", F.pandas_udf(replaced, "string")(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents`` (null: empty); offsets in code points, ends exclusive."""
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin(*KINDS[:3]))
    return rows.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"))
