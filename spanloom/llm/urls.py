"""URL filters: rules by host and path, then a list of canonical URLs behind a blocked Bloom filter.

The filter has one 64-bit word per block and sets six bits of it for each listed URL.  Pages that miss
it are surely not listed and are never shuffled; possible hits go to an exact join with the list, which
removes the false positives.  Only DataFrame functions are used.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is
allowed; repeated rows stay; an empty list allows what no rule blocks; an empty table gives an empty
result; further columns are kept by ``judge`` whatever their names, but for those of its own results, which
it replaces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.runtime import cut, table

NAME = "op9_url_filter"

#: (verdict, host/path)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Host labels whose pages make up the query's list of known bad URLs.
BAD_LABELS = ("spam-farm", "cheap-pills", "casino-win", "ads-track", "free-bets")

#: What ``judge`` adds.
RESULTS = ("host", "path", "rule", "verdict", "in_list")

BITS_SET = 6
URLS_PER_BLOCK = 4
#: A filter of at most so many blocks (16 bytes each) is broadcast; a larger one is joined by shuffle.
MAX_BROADCAST_BLOCKS = 1 << 19

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest_of(url), r"^[^/?#]*", 0), _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without a trailing slash or ``.html``, query without tracking."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(?:/|\.html)$", "")
    query = F.regexp_extract(rest_of(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(?:utm_\w+|ref)=")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        of, slash, start = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _block(url: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(n))


def _mask(url: Column) -> Column:
    h = F.xxhash64(url, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(BITS_SET)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """pages with a url column; listed with a url column.  Adds host, path, rule, verdict, in_list."""
    listed = cut(listed.where(F.col("url").isNotNull()).select(canonical(F.col("url")).alias("canon")).where("canon <> ''").distinct())
    n_blocks = 1 << max(4, (listed.count() // URLS_PER_BLOCK).bit_length())
    bloom = listed.groupBy(_block(F.col("canon"), n_blocks).alias("bloom_block")).agg(F.bit_or(_mask(F.col("canon"))).alias("bloom_bits"))
    if n_blocks <= MAX_BROADCAST_BLOCKS:
        bloom = F.broadcast(bloom)

    # The page's own columns travel as one, so that no name of theirs meets one of ours.
    pages = pages.drop(*RESULTS)
    kept = [F.col("page")[c].alias(c) for c in pages.columns]
    url = F.col("page")["url"]
    pages = pages.select(F.struct(*(f"`{c}`" for c in pages.columns)).alias("page"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    pages = pages.select("page", host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce(canonical(url), F.lit("")).alias("canon"))
    pages = pages.select("*", rule.alias("rule"), says.alias("rule_says"), _block(F.col("canon"), n_blocks).alias("bloom_block"))
    probed = pages.join(bloom, "bloom_block", "left")
    want = _mask(F.col("canon"))
    probed = probed.withColumn("possible", F.coalesce(F.col("bloom_bits").bitwiseAND(want) == want, F.lit(False)))
    out = [*kept, "host", "path", "rule", F.coalesce("rule_says", F.when(F.col("in_list"), "block").otherwise("allow")).alias("verdict"), "in_list"]
    clear = probed.where(~F.col("possible")).withColumn("in_list", F.lit(False)).select(out)
    exact = listed.select(F.col("canon"), F.lit(True).alias("found"))
    checked = probed.where("possible").join(exact, "canon", "left").withColumn("in_list", F.coalesce("found", F.lit(False))).select(out)
    return clear.unionByName(checked)


def bad_pages(pages: DataFrame, labels=BAD_LABELS) -> DataFrame:
    """The URLs of pages on hosts that carry one of the labels."""
    found = F.arrays_overlap(F.split(host_of(F.col("url")), r"\."), F.array(*map(F.lit, labels)))
    return pages.where(found).select("url")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, bad_pages(pages)).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH r AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, rest,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM r
), c AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_\w+|ref)='))) AS params
  FROM h
), k AS (
  SELECT page_id, host, path,
         coalesce(regexp_replace(host, '^(?:www|m)\.', '') || regexp_replace(path, '(?:/|\.html)$', '')
                  || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END, '') AS canon,
         list_has_any(string_split(host, '.'), ['spam-farm', 'cheap-pills', 'casino-win', 'ads-track', 'free-bets']) AS bad
  FROM c
), listed AS (SELECT DISTINCT canon FROM k WHERE bad AND canon <> '')
SELECT page_id, host, path,
       CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
            WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
       CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'allow'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'block'
            WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'allow'
            WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'block'
            WHEN canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM k
"""
