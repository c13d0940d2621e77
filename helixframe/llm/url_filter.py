"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join. DataFrame functions only.

Two kinds of entry decide about a page. Rules (a host with its subdomains and a path prefix) are few and become one expression.
Listed URLs are many: each is brought to a canonical form, whose hash picks one 64-bit block of the filter and some of its bits.
The filter is packed, `GROUP` blocks to a row and 8 bytes to a block, and broadcast behind a check of its size; pages whose bits are not
all set pass by without a shuffle, the others go through the exact join, which removes false positives. A list too long for the
broadcast goes to the exact join directly. Every page row is judged by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, small

BITS = 5
#: Listed URLs for a block (16 bits each), blocks of a row of the packed filter.
PER_BLOCK, GROUP = 4, 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPAM = "casino|bets|pills"
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host up to / ? # after the first ://, A-Z lower-cased; path from there up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """host and path without scheme, query, fragment, a leading www. or m., a trailing slash or .html; null without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html?|/)\z", "")))


def spam_list(pages: DataFrame) -> DataFrame:
    """listed(url, verdict): the pages of a crawl that belong to hosts which sell bets or pills, to be blocked wherever they are mirrored."""
    return pages.where(url_parts(F.col("url"))[0].rlike(SPAM)).select("url", F.lit("block").alias("verdict"))


def _mask(key: Column) -> Column:
    """The bits of a key inside its block."""
    h = F.xxhash64(key, F.lit("bits"))
    out = F.lit(0).cast("long")
    for i in range(BITS):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return out


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def build_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """Rows (group, words) of the packed filter for keys(key); absent blocks are 0."""
    words = keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("word"))
    entry = F.map_from_entries(F.collect_list(F.struct((F.col("block") % GROUP).cast("int"), "word")))  # at most GROUP blocks
    packed = words.groupBy((F.col("block") / GROUP).cast("long").alias("group")).agg(entry.alias("m"))
    return packed.select("group", F.transform(F.sequence(F.lit(0), F.lit(GROUP - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("words"))


def url_filter(spark: SparkSession, pages: DataFrame, rules: list = RULES, listed: DataFrame | None = None) -> DataFrame:
    """Per page row: page_id, host, path, rule, verdict.

    rules: (verdict, host, path); one fits its host and all subdomains where the page's path starts with its own; the
    longest wins, then the one that sorts first. listed(url, verdict): whole URLs, compared in canonical form, for pages that no
    rule fits (their rule stays null); of two verdicts on one URL the larger holds. What nothing lists is allowed. A url that is
    null or has no :// has an empty host and path and is allowed. Repeated rows are judged each, null page_ids too; an empty
    table gives no rows; other columns are ignored.
    """
    host, path = url_parts(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    hit = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, start in sorted((r for r in rules if r[1] and r[2] is not None), key=lambda r: (len(r[1] + r[2]), r[1] + r[2], r[0]), reverse=True)[::-1]:
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(start)
        hit = F.when(fits, F.struct(F.lit(h + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(hit)
    p = p.withColumn("hit", hit)
    out = ["page_id", "host", "path", F.col("hit.rule").alias("rule")]
    if listed is None:
        return p.select(*out, F.coalesce("hit.verdict", F.lit("allow")).alias("verdict"))
    entries = listed.where("url IS NOT NULL").select(canonical(*url_parts(F.col("url"))).alias("key"), "verdict").where("key IS NOT NULL")
    entries = cut(spark, entries.groupBy("key").agg(F.max("verdict").alias("verdict")).withColumnsRenamed({"key": "entry", "verdict": "listed"}), "listed")
    count = entries.count()
    p = p.withColumn("key", F.when(F.col("hit").isNull(), canonical(F.col("host"), F.col("path"))))
    blocks = max(GROUP, -(-count // PER_BLOCK))
    found = small(entries, count, 400)
    if 8 * blocks > BROADCAST_BYTES:
        asked = p.where("key IS NOT NULL").join(found, F.col("key") == F.col("entry"), "left")
        passed = p.where("key IS NULL")
    else:
        words = F.broadcast(build_filter(entries.select(F.col("entry").alias("key")), blocks))
        block = _block(F.coalesce("key", F.lit("")), blocks)
        p = p.join(words, (block / GROUP).cast("long") == F.col("group"), "left")
        word = F.coalesce(F.get("words", (block % GROUP).cast("int")), F.lit(0).cast("long"))
        possible = F.col("key").isNotNull() & (word.bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key")))
        asked = p.where(possible).join(found, F.col("key") == F.col("entry"), "left")
        passed = p.where(~F.coalesce(possible, F.lit(False)))
    judged = asked.select(*out, F.coalesce("listed", F.lit("allow")).alias("verdict"))
    return judged.unionByName(passed.select(*out, F.coalesce("hit.verdict", F.lit("allow")).alias("verdict")))


SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (
  SELECT row_number() OVER () AS row, page_id, coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h
), c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(\\.html?|/)\\z', '') END AS key FROM p),
l AS (SELECT DISTINCT key AS entry FROM c WHERE regexp_matches(host, 'casino|bets|pills') AND key IS NOT NULL),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT c.*, r.verdict AS v, rhost || rpath AS rule,
         row_number() OVER (PARTITION BY row ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM c LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN entry IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM m LEFT JOIN l ON key = entry WHERE k = 1
"""
