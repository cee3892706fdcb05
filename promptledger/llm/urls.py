"""URL filters: path rules on host suffixes, then a blocked Bloom filter of listed
canonical URLs whose possible hits an exact hash join confirms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, table

#: Fixed values: (verdict, rule) as "host/path".
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Parts of host labels whose pages' canonical URLs are listed.
LISTED_PARTS = ("adult", "ads", "bets", "casino", "pills", "spam")
#: A block has 8 words of 32 bits; every URL sets one bit in each.
BLOCK_WORDS = 8
BITS_PER_URL = 12
#: The filter is broadcast up to this size, else joined by block.
BROADCAST_BYTES = 8 << 20
#: The list itself is broadcast up to this many URLs; beyond, possible hits are shuffled to it and the rest are not.
BROADCAST_URLS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def host_of(url: Column) -> Column:
    """A-Z lower-cased host; empty for a null url or one without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def canonical_of(url: Column) -> Column:
    """One spelling for a page: no scheme, ``www.`` or ``m.``, default port, fragment,
    tracking parameters, trailing slash or ``.html``; parameters in order. Null without a host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"(\.html?|/)+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(url, _URL, 3), "&"), lambda p: ~p.rlike("^(utm_[^=]*|ref|gclid|fbclid)(=|$)") & (p != "")))
    query = F.array_join(params, "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls: rules are tried from long to short."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule = F.when(fits, F.lit(r)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, word: int) -> Column:
    """The one bit that ``key`` sets in a word of its block."""
    probe = F.shiftrightunsigned(F.xxhash64(key, F.lit("bit")), 5 * word).bitwiseAND(F.lit(31).cast("long"))
    return F.call_function("shiftleft", F.lit(1), probe.cast("int"))


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter as a table: ``block`` and its words, or-ed from ``listed(canonical)``."""
    rows = listed.select(_block(F.col("canonical"), blocks).alias("block"), *[_bit(F.col("canonical"), k).alias(f"w{k}") for k in range(BLOCK_WORDS)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(BLOCK_WORDS)])


def mark_listed(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """``urls(…, canonical)`` with ``listed`` true where the canonical URL is in ``listed(canonical)``.

    Only rows that the filter lets through are joined with the list, where its false
    positives end. Null canonical URLs are not listed; a ``listed`` column of ``urls``
    is replaced, all others stay.
    """
    rest = [c for c in urls.columns if c.lower() != "listed"]
    listed = listed.where("canonical is not null").select(F.col("canonical").alias(free_name("_url", urls))).distinct()
    (key,), block, maybe = listed.columns, free_name("_block", urls), free_name("_maybe", urls)
    words = [free_name(f"_word{k}", urls) for k in range(BLOCK_WORDS)]
    n = listed.count()
    blocks = max(1, -(-n * BITS_PER_URL // (32 * BLOCK_WORDS)))
    bloom = bloom_filter(listed.withColumnRenamed(key, "canonical"), blocks).toDF(block, *words)
    if blocks * (8 + 4 * BLOCK_WORDS) <= BROADCAST_BYTES:
        bloom = F.broadcast(bloom)
    hit = F.lit(True)
    for k, word in enumerate(words):
        hit = hit & (F.col(word).bitwiseAND(_bit(F.col("canonical"), k)) == _bit(F.col("canonical"), k))
    # a url without a canonical form gets a block of its own hash, so nulls do not gather
    at = F.when(F.col("canonical").isNull(), F.lit(-1) - F.pmod(F.monotonically_increasing_id(), F.lit(1024))).otherwise(_block(F.col("canonical"), blocks))
    probed = urls.select(*rest, at.alias(block)).join(bloom, block, "left").select(*rest, F.coalesce(hit, F.lit(False)).alias(maybe))
    told = lambda rows, value: rows.select(*rest, value.alias("listed"))
    exact = lambda rows, own: rows.join(own, rows["canonical"] == own[key], "left")
    if n <= BROADCAST_URLS:  # no shuffle: one pass looks all rows up, but only possible hits in the list
        own = F.broadcast(listed)
        found = probed.join(own, probed[maybe] & (probed["canonical"] == own[key]), "left")
        return told(found, F.col(key).isNotNull())
    hits = told(exact(probed.where(F.col(maybe)), listed), F.col(key).isNotNull())
    return hits.unionByName(told(probed.where(~F.col(maybe)), F.lit(False)))


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical, listed of every row of ``pages``."""
    url = F.col("url").cast("string")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical_of(url).alias("canonical"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    marked = mark_listed(parsed, listed)
    return marked.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "canonical", "listed")


def listing(pages: DataFrame, parts=LISTED_PARTS) -> DataFrame:
    """Canonical URLs of pages on hosts with a label part of ``parts``: the list that op9 uses."""
    url = F.col("url").cast("string")
    return pages.where(host_of(url).rlike(r"(^|[.-])(" + "|".join(parts) + r")([.-]|$)")).select(canonical_of(url).alias("canonical")).distinct()


def op9_urls(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, listing(pages))


_PARTS_SQL = "|".join(LISTED_PARTS)
ORACLE_SQL = rf"""
with split as (
  select page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
         coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '') as query
  from pages),
named as (
  select *, case when host <> '' then
      regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(path, '(\.html?|/)+$', '')
      || case when q <> '' then '?' || q else '' end end as canonical
  from (select *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))), '&') as q from split)),
listing as (
  select distinct canonical from named where regexp_matches(host, '(^|[.-])({_PARTS_SQL})([.-]|$)') and canonical is not null),
ruled as (
  select n.*, l.canonical is not null as listed,
    case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
         when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
         when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
         when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
  from named n left join listing l on n.canonical = l.canonical)
select page_id, host, path, rule,
       case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block' when listed then 'block' else 'allow' end as verdict,
       canonical, listed
from ruled
"""
