"""URL filters: host and path rules, and a listed-URL test by a blocked Bloom filter with an exact join behind it.

Everything is DataFrame expressions.  The filter is a table with a row for each block of 256 bits
(eight 32-bit words, one bit of each set by a URL).  It is broadcast while its number of blocks,
which is known before, is at most `max_blocks`; a larger one is joined by block number.  Possible hits
go on to a hash join with the list itself, so that no false positive remains; the others need no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import BITS, MAX_BLOCKS, bloom, blocks_for, passes
from .common import fresh, materialise

#: Fixed values: (action, host, path); a rule fits its host and all subdomains, and paths that begin with its own.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Rules are one expression; more of them belong into a list of URLs.
MAX_RULES = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://, or for null."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without www. and a default port, path without a slash at the end, other than tracking parameters sorted; no scheme, no fragment."""
    bare = F.regexp_replace(F.regexp_replace(host(url), "^www\\.", ""), ":(80|443)$", "")
    query = F.regexp_extract(_rest(url), "^[^?#]*\\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^(utm_[a-z]+|gclid|fbclid)="))), "&")
    return F.concat(bare, F.regexp_replace(path(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def rule_of(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path as one string), of equally long ones the last, and its action; null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: list the URLs instead")
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        name, action = F.when(fits, h + p).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def listed_urls(urls: DataFrame, listed: DataFrame, max_blocks: int = MAX_BLOCKS, bits: int = BITS) -> DataFrame:
    """urls (with a column canonical) plus `listed`: whether listed(canonical) has it.  Null or empty ones are not listed.

    Every row and column of urls stays, but for one named listed, which is replaced; repeated rows of listed do no harm.  The
    list and the probed rows are written once, as the filter and the join both read the one and hits and others the other.
    """
    urls = urls.drop("listed")
    known = materialise(listed.select("canonical").where("canonical <> ''").distinct(), "listed")
    blocks = blocks_for(known.count(), bits)
    block, filled, maybe = (fresh(c, urls) for c in ("block", "filled", "maybe"))
    table = bloom(known, "canonical", blocks)
    table = table.select(F.col("block").alias(block), F.struct(*(f"m{i}" for i in range(8))).alias(filled))
    key = F.coalesce(F.col("canonical"), F.lit(""))
    met = urls.withColumn(block, F.pmod(F.xxhash64(key), F.lit(blocks))).join(F.broadcast(table) if blocks <= max_blocks else table, block, "left")
    probed = materialise(met.withColumn(maybe, passes(filled, key)).select(*urls.columns, maybe), "probed")
    exact = known.withColumn("listed", F.lit(True)).hint("shuffle_hash")
    hits = probed.where(F.col(maybe)).join(exact, "canonical", "left").select(*urls.columns, F.coalesce("listed", F.lit(False)).alias("listed"))
    return hits.union(probed.where(~F.col(maybe)).select(*urls.columns, F.lit(False).alias("listed")))


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict, canonical, listed; a row for each row.

    A rule decides; where none fits, a listed URL is blocked and any other allowed.  A null or empty url, and one without ://,
    has an empty host and path, no rule and the verdict allow.  Repeated rows and null ids each give their row; other
    columns of pages are not looked at, so their names cannot clash.
    """
    u = F.col("url")
    parts = pages.select("page_id", F.coalesce(host(u), F.lit("")).alias("host"), F.coalesce(path(u), F.lit("")).alias("path"), F.coalesce(canonical(u), F.lit("")).alias("canonical"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    out = listed_urls(parts, listed)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "canonical", "listed")


def op3_query(spark, sf_dir: str) -> DataFrame:
    """The list: canonical URLs of the pages whose id a label marks as toxic or of low quality."""
    from .common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    marked = table(spark, sf_dir, "labels").where("toxic = 1 or quality = 0").select(F.col("doc_id").alias("page_id")).distinct()
    return judge(pages, pages.join(marked, "page_id").select(canonical(F.col("url")).alias("canonical")))


_HOST = f"translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}')"
OP3_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  list_aggregate(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid)='))), 'string_agg', '&') AS query FROM cut),
named AS (SELECT page_id, host, path, regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
  || CASE WHEN coalesce(query, '') <> '' THEN '?' || query ELSE '' END AS canonical FROM parts),
listed AS (SELECT DISTINCT canonical FROM named WHERE canonical <> '' AND page_id IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)),
rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) r(action, h, p)),
ruled AS (SELECT named.*, canonical IN (SELECT canonical FROM listed) AS listed,
  (SELECT max_by(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule FROM named)
SELECT page_id, host, path, rule, coalesce((SELECT action FROM rules WHERE h || p = rule), CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict,
  canonical, listed FROM ruled
"""
