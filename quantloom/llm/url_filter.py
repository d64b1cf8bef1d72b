"""URL filters: ordered rules by host and path, and a list of canonical URLs behind a blocked Bloom filter.

The filter is a table with a row for each block of eight 64-bit lanes; a URL sets one bit in each lane of one block.
A page joins at most one block, which passes all listed URLs and few others; those go on to an exact join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LANES = 8
#: Listed URLs per block: 512 bits for 32 entries of eight bits each, under one false hit in a thousand.
PER_BLOCK = 32
#: Blocks of at most so many bytes are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class UrlRule:
    """Fits the host and its subdomains, if the path starts with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("block", "com", "/en/"),
    UrlRule("allow", "example.com", "/en/7"),
    UrlRule("allow", "net", "/de/"),
    UrlRule("block", "example.net", "/de/8"),
    UrlRule("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, with A-Z in lower case; empty for null or where there is no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host, path without its last slash, and query: scheme and fragment do not matter. Null where there is no host."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.when(host_of(url) != "", F.concat(host_of(url), F.regexp_replace(path_of(url), "/$", ""), query))


def matched_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The longest fitting rule as (text, verdict), or null; of equally long ones that which stands first."""
    fits = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        here = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        value = F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))
        fits = F.when(here, value) if fits is None else fits.when(here, value)
    return fits if fits is not None else F.lit(None).cast("struct<text:string,verdict:string>")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _lane_bits(key: Column) -> list[Column]:
    """One bit for each lane: six bits each of a second hash."""
    h = F.xxhash64(F.lit("lanes"), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(LANES)]


def bloom_blocks(keys: DataFrame, blocks: int, key: str = "key") -> DataFrame:
    """(block, lane0...): the filter of all keys; map-side aggregated, so a repeated key costs nothing."""
    lanes = [b.alias(f"lane{k}") for k, b in enumerate(_lane_bits(F.col(key)))]
    bits = keys.filter(F.col(key).isNotNull()).select(_block(F.col(key), blocks).alias("block"), *lanes)
    return bits.groupBy("block").agg(*(F.bit_or(f"lane{k}").alias(f"lane{k}") for k in range(LANES)))


def listed(urls: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of `urls` (key and others, no lane or block column) whose key is among `keys`: Bloom filter, then exact join.

    Null keys are never listed; repeated keys of the list do not repeat rows.
    """
    n = keys.count()
    blocks = max(1, -(-n // PER_BLOCK))
    table = bloom_blocks(keys, blocks)
    if blocks * (LANES + 2) * 8 <= BROADCAST_BYTES:
        table = F.broadcast(table)
    probe = urls.withColumn("block", _block(F.col("key"), blocks)).join(table, "block")
    for k, bit in enumerate(_lane_bits(F.col("key"))):
        probe = probe.filter(F.col(f"lane{k}").bitwiseAND(bit) != 0)
    return probe.select(*urls.columns).join(keys.select("key").distinct(), "key", "left_semi")


def filter_urls(pages: DataFrame, listing: DataFrame, rules: tuple[UrlRule, ...] = RULES, url: str = "url", listing_url: str = "url") -> DataFrame:
    """The rows of `pages` with host, path, rule and verdict (allow or block).

    The longest fitting rule decides; where none fits, a URL is blocked if its canonical form is that of a listed URL.
    Null URLs, and those without ://, have an empty host and path, fit no rule, are never listed and so are allowed.
    Columns of `pages` named like a result are replaced. Repeated rows keep a row each.
    """
    keys = listing.select(canonical(F.col(listing_url)).alias("key")).filter(F.col("key").isNotNull()).distinct()
    names = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    judged = pages.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), canonical(F.col(url)).alias("key"))
    judged = judged.withColumn("fit", matched_rule(F.col("host"), F.col("path"), rules))
    blocked = listed(judged.filter(F.col("fit").isNull() & F.col("key").isNotNull()).select("key").distinct(), keys).select("key", F.lit(True).alias("hit"))
    out = judged.join(blocked, "key", "left")
    verdict = F.coalesce(F.col("fit")["verdict"], F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(*(F.col("row")[c].alias(c) for c in names), "host", "path", F.col("fit")["text"].alias("rule"), verdict.alias("verdict"))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """The listed URLs are those of the pages whose id is divisible by 20; a fragment or another scheme does not hide them."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listing = pages.filter(F.col("page_id") % 20 == 0).select("url")
    return filter_urls(pages, listing).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(url, '^[\s\S]*?://[^?#]*(\?[^#]*)', 1), '') AS query
  FROM pages),
k AS (SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '/$', '') || query END AS key FROM p),
l AS (SELECT DISTINCT key FROM k WHERE page_id % 20 = 0 AND key IS NOT NULL),
r AS (
  SELECT k.*, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM k)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN l ON r.key = l.key
"""
