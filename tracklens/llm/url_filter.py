"""URL filter: a blocked Bloom filter over listed canonical URLs, then an exact hash join. JVM only.

Listed URLs set four bits in one 256-bit block each (four longs, one bit in each), so a probe reads one row of
the block table. A URL whose bits are all set is a possible hit and goes to the exact join, which removes
false positives; no listed URL is ever missed. Pages are read once: what cannot be a hit joins with a null key
while the list is broadcast, or with a key of its own, so that a shuffled join has no hot one.

Defined cases: a null URL or one without `://` has empty host and path, fits no rule and is allowed; repeated
page ids are judged one by one; repeated and unparsable listed URLs count once and never; an empty list blocks
nothing; an empty table gives no rows; other columns of the pages are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .native import BROADCAST_BYTES, ascii_lower, bloom, bloom_blocks, possible_hits

#: Fixed values: (verdict, host, path) of the rules; the longest that fits wins.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: The query's list, in place of a file that users pass: every page number below LISTED_PAGES of these sites and languages.
LISTED_SITES = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_DOMAINS, LISTED_LANGUAGES, LISTED_PAGES = ["example.net", "example.org"], ["en", "de", "fr", "es"], 5000


def host(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.substr(url, at + 3)
    return F.coalesce(F.when(at > 0, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))), F.lit(""))


def path(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def canonical(h: Column, p: Column) -> Column:
    """Host without a leading www. or m., path without trailing slashes and .html; query and fragment are no part of it."""
    return F.concat(F.regexp_replace(h, r"^(www|m)\.", ""), F.regexp_replace(p, r"(\.html)?/*$", ""))


def fitting(h: Column, p: Column, rules: list[tuple[str, str, str]], value) -> Column:
    """value(rule) of the longest rule that fits, else null. The rules are a parameter, so they become one expression."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    return F.coalesce(F.lit(None).cast("string"), *(F.when(((h == rh) | h.endswith(f".{rh}")) & p.startswith(rp), F.lit(value((v, rh, rp)))) for v, rh, rp in order))


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict. listed: a table whose column `url` holds URLs to block where no rule fits."""
    parsed = pages.select(F.col("page_id"), F.col("url").cast("string").alias("_raw")).select("page_id", host(F.col("_raw")).alias("host"), path(F.col("_raw")).alias("path"))
    h, p = F.col("host"), F.col("path")
    ruled = parsed.withColumn("rule", fitting(h, p, rules, lambda r: r[1] + r[2])).withColumn("_verdict", fitting(h, p, rules, lambda r: r[0]))
    keys = listed.select(F.col("url").cast("string").alias("_raw")).select(canonical(host(F.col("_raw")), path(F.col("_raw"))).alias("_listed")).where("_listed <> ''").distinct()
    keys = Scratch(pages.sparkSession, "urls").table(keys, "listed")
    n, n_bytes = keys.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_listed") + 32), F.lit(0))).first()
    open_ = ruled.withColumn("_url", F.when(F.col("_verdict").isNull(), canonical(h, p)))
    n_blocks = bloom_blocks(n)
    probed = possible_hits(open_, "_url", bloom(keys, "_listed", n_blocks), n_blocks).withColumn("_maybe", F.col("_maybe") & F.col("_url").isNotNull())
    fits = n_bytes <= BROADCAST_BYTES
    other = F.lit(None).cast("string") if fits else F.concat(F.lit(" "), F.xxhash64("page_id", "host", "path").cast("string"))  # no listed URL starts with a space
    exact = probed.withColumn("_probe", F.when(F.col("_maybe"), F.col("_url")).otherwise(other)).join(F.broadcast(keys) if fits else keys, F.col("_probe") == F.col("_listed"), "left")
    method = F.when(F.col("_listed").isNotNull(), "block").otherwise("allow")
    return exact.select("page_id", "host", "path", "rule", F.coalesce("_verdict", method).alias("verdict"))


def listed_pages(spark) -> DataFrame:
    """url: the query's list, built by its rule."""
    array = lambda xs: F.array(*map(F.lit, xs))
    each = spark.range(LISTED_PAGES).select("id", F.explode(array(LISTED_SITES)).alias("site")).select("*", F.explode(array(LISTED_DOMAINS)).alias("domain")).select("*", F.explode(array(LISTED_LANGUAGES)).alias("lang"))
    return each.select(F.format_string("http://%s.%s/%s/%d", "site", "domain", "lang", "id").alias("url"))


def op6(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), listed_pages(spark))


SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
c AS (SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html)?/*$', '') AS url FROM h),
r(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
l AS (SELECT site || '.' || domain || '/' || lang || '/' || id AS url FROM unnest(['adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) AS s(site),
      unnest(['example.net', 'example.org']) AS d(domain), unnest(['en', 'de', 'fr', 'es']) AS g(lang), unnest(range(5000)) AS n(id)),
m AS (SELECT page_id, host, path, url, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
      FROM c LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN url IN (SELECT url FROM l) THEN 'block' ELSE 'allow' END) AS verdict FROM m
"""
