"""Line-first quality rules: judge every line, drop those that fail, then the
documents that lose too much of their text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ascii_words, free_name, table, utf8

SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|>"
#: Ends that a sentence line may have.
TERMINALS = ".!?:;\"')]…。！？”’»」』）"
#: Phrases of boilerplate lines.
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "enable javascript", "log in to", "lorem ipsum", "privacy policy",
    "read more", "share this", "sign up for", "skip to content", "subscribe to", "terms of service", "terms of use",
)
BOILERPLATE_WORDS = 60
SENTENCE_WORDS = 8
REPETITIVE_WORDS = 10
#: A document goes if more than this many tenths of its words are in failed lines.
MOST_LOST_TENTHS = 3
WINDOW = 8
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_MIX = np.random.default_rng(8).integers(1, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)


def failed_rule(line: str, words: list[bytes]) -> str | None:
    """The first rule that a line with words fails: navigation, symbols, exclamation,
    repetition, boilerplate or punctuation; None for a good line."""
    n = len(words)
    separators = sum(map(line.count, SEPARATORS))
    if separators >= 3 and 4 * separators >= n:
        return "navigation"
    if 2 * sum(map(line.count, SYMBOLS)) >= n:
        return "symbols"
    if n >= 4 and 2 * line.count("!") >= n:
        return "exclamation"
    if n >= REPETITIVE_WORDS and 5 * len(set(words)) < n:
        return "repetition"
    if n <= BOILERPLATE_WORDS and _BOILERPLATE.search(line.lower()):
        return "boilerplate"
    if n >= SENTENCE_WORDS and line.rstrip(SPACES)[-1:] not in TERMINALS:
        return "punctuation"
    return None


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that the list has twice or more; equal hashes are compared word by word."""
    if len(words) <= window:
        return 0
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    if len(number) == len(words):
        return 0
    codes = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
    n = len(codes) - window + 1
    h = codes[:n] * _MIX[0]
    for k in range(1, window):
        h += codes[k : k + n] * _MIX[k]
    ordered = np.sort(h)
    same = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(same):
        return 0
    at = np.nonzero(np.isin(h, same))[0]
    rows = np.lib.stride_tricks.sliding_window_view(codes, window)[at]
    _, which, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    at = at[counts[which.ravel()] >= 2]
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def judge(text: str | None) -> dict:
    """Counts, verdict and cleaned text of one text (null: empty)."""
    text = text or ""
    words = ascii_words(text)
    seen: set[str] = set()
    n_dup = lost = 0
    good: list[str] = []
    failed: dict[str, int] = {}
    for line in text.split("\n"):
        own = utf8(line).split()
        if not own:
            good.append(line)
            continue
        n_dup += line in seen
        seen.add(line)
        if rule := failed_rule(line, own):
            failed[rule] = failed.get(rule, 0) + 1
            lost += len(own)
        else:
            good.append(line)
    repeated = repeat_words(words)
    n = len(words)
    base_failed = n < 20 or 100 * repeated > 30 * n
    return {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": n_dup,
        "n_repeat_words": repeated,
        "base_failed": base_failed,
        "kept": not base_failed and 10 * lost <= MOST_LOST_TENTHS * n,
        "n_lost_words": lost,
        "failed_lines": sum(failed.values()),
        "clean_text": "\n".join(good),
    }


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lost_words long, failed_lines long"


def apply_rules(docs: DataFrame, clean_text: bool = True, into: str = "rules") -> DataFrame:
    """``docs`` with a struct ``into`` (in place of a column of that name) of what ``judge`` finds; ``clean_text`` on demand.

    A null text counts as empty; every row stays.
    """
    schema = COLUMNS + (", clean_text string" if clean_text else "")

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [judge(t) for t in texts]
            if not clean_text:
                for r in rows:
                    del r["clean_text"]
            names = [c.split(" ")[0] for c in schema.split(", ")]
            yield pd.DataFrame(rows, columns=names)

    return docs.withColumn(into, F.pandas_udf(judged, schema)(F.col("text").cast("string")))


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents with failed lines removed; ``docs``' own columns. Null and empty texts fail the base rules and go."""
    own = free_name("_rules", docs)
    kept = apply_rules(docs, into=own).where(F.col(own)["kept"])
    return kept.withColumn("text", F.col(own)["clean_text"]).select(docs.columns)


def op6_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs, clean_text=False).select("doc_id", "rules.*")


_BOILERPLATE_SQL = "|".join(BOILERPLATE)
ORACLE_SQL = rf"""
with docs as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
tokens as (
  select rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from docs),
lines as (
  select rid, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n,
         len(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) as u,
         length(line) - length(regexp_replace(line, '[|>]', '', 'g')) as seps,
         length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) as syms,
         length(line) - length(replace(line, '!', '')) as bangs
  from (select rid, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from docs)),
judged as (
  select *, row_number() over (partition by rid, line order by pos) > 1 as dup,
    (seps >= 3 and 4 * seps >= n) or 2 * syms >= n or (n >= 4 and 2 * bangs >= n) or (n >= 10 and 5 * u < n)
    or (n <= {BOILERPLATE_WORDS} and regexp_matches(lower(line), '{_BOILERPLATE_SQL}'))
    or (n >= {SENTENCE_WORDS} and not regexp_matches(line, '[.!?:;"'')\]…。！？”’»」』）][\x20\x09-\x0D]*$')) as failed
  from lines where n > 0),
per_line as (
  select rid, count(*) filter (where dup) as n_dup, sum(n) filter (where failed) as lost, count(*) filter (where failed) as bad
  from judged group by rid),
windows as (
  select rid, i, array_to_string(w[i:i + 7], ' ') as win
  from (select rid, w, unnest(range(1, len(w) - 6)) as i from tokens where len(w) >= 8)),
again as (
  select rid, i from (select rid, i, count(*) over (partition by rid, win) as c from windows) where c > 1),
covered as (
  select rid, count(distinct i + k) as n from again, range(0, 8) r(k) group by rid)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and 10 * n_lost_words <= {MOST_LOST_TENTHS} * n_words as kept, n_lost_words, failed_lines
from (
  select t.doc_id, len(w) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
         cast(coalesce(n_dup, 0) as bigint) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words,
         len(w) < 20 or 100 * coalesce(c.n, 0) > 30 * len(w) as base_failed,
         cast(coalesce(lost, 0) as bigint) as n_lost_words, cast(coalesce(bad, 0) as bigint) as failed_lines
  from tokens t left join per_line using (rid) left join covered c using (rid))
"""
