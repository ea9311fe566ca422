"""URL rules and lists: a blocked Bloom filter passes possible hits to an exact hash join.

An entry is a host and a path, as in ``example.com/en/``: it fits its host and all subdomains where the URL's path
starts with the entry's. Entries are rules (allow or block; the longest wins, and of those as long the one with the
longest host, then the last by code point) or plain list entries, which block what no rule decides; whatever is left
is allowed. Rules are compared with the host and path as they stand. List entries are compared in canonical form: no
user, port or points at the end of the host, percent escapes decoded, an empty path is ``/``; so are the entries.

A URL's candidates are its host's suffixes of as many labels as some entry has, each with the starts of its path as long
as some entry's path; how many there are depends on the entries alone, and a very long host costs its length.
Candidates are looked up in a filter of 256-bit blocks (one bit in each of eight words), a table by itself: broadcast
while its size is proven small, joined by block beyond it. What passes is joined to the entries.

Each distinct URL is judged once; rows of one URL are dealt to ``SALTS`` tasks when its verdict is joined back, so a URL
that many rows have does not land in one. Edge cases: a null URL, or one without ``://``, has empty host and path, fits
nothing and is allowed; repeated rows are judged alike; an empty table gives an empty result; other columns are
ignored; entries that are null or repeated count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of the query: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Listed canonical URLs of the query, by host and start of path.
LISTED = tuple((f"{name}.example.{top}", "/") for name in ("adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("net", "org"))
BITS = 16  # of the filter for each entry
#: Blocks (48 bytes each) of a filter that may be broadcast.
BROADCAST_BLOCKS = 1 << 17
SALTS = 16
#: Before the keys of rules and of list entries.
RULE, LIST = "r ", "l "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_host(host: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.regexp_replace(host, r"^[\s\S]*@", ""), r":[0-9]*\z", ""), F.lit("."))


def canonical_path(path: Column) -> Column:
    """Escapes that are no UTF-8 stay."""
    return F.when(path == "", "/").otherwise(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path))


def entries_of(spark: SparkSession, rules=RULES, listed=LISTED) -> DataFrame:
    """Entries (host, path, verdict; verdict null for list entries) of constants."""
    rows = [(h, p, v) for v, h, p in rules] + [(h, p, None) for h, p in listed]
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def masks(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(8)]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter of column ``key``: a row for each block that is not empty."""
    rows = keys.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), *(m.alias(f"m{i}") for i, m in enumerate(masks(F.col("key")))))
    return rows.groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"w{i}") for i in range(8)))


def possible(candidates: DataFrame, keys: DataFrame) -> DataFrame:
    """Candidates (with column ``key``) that the filter of keys lets through."""
    blocks = max(1, -(-keys.count() * BITS // 256))
    words = bloom(keys, blocks)
    words = F.broadcast(words) if blocks <= BROADCAST_BLOCKS else words
    hit = F.lit(True)
    for i, m in enumerate(masks(F.col("key"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) != 0)
    joined = candidates.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).join(words, "block")
    return joined.filter(hit).select(candidates.columns)


def keys_of(urls: DataFrame, kind: str, host: Column, path: Column, entries: DataFrame) -> DataFrame:
    """(url, key) of all host suffixes and path starts that an entry of this kind may have."""
    own = entries.filter(F.startswith("key", F.lit(kind)))
    # At most as many as the longest entry's path has characters, and its host labels.
    lengths = sorted(r[0] for r in own.select(F.length("path")).distinct().collect())
    counts = sorted(r[0] for r in own.select("labels").distinct().collect())
    if not lengths:
        return urls.select("url", F.lit("").alias("key")).limit(0)
    suffixes = F.array_distinct(F.array(*(F.substring_index(host, ".", -n) for n in counts)))
    starts = F.filter(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)), lambda x: x.isNotNull())
    return urls.filter(host != "").select("url", F.explode(F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(F.lit(kind), s, p)))))).alias("key"))


def judge_urls(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, path, rule (the deciding rule's host and path), verdict and listed, one row per page."""
    rule = F.col("verdict").isNotNull()
    host, path = (F.when(rule, F.col(c)).otherwise(f(F.col(c))).alias(c) for c, f in (("host", canonical_host), ("path", canonical_path)))
    entries = entries.filter("host is not null and path is not null").select(host, path, "verdict").withColumn("key", F.concat(F.when(rule, RULE).otherwise(LIST), "host", "path"))
    entries = entries.groupBy("key").agg(F.max(F.when(rule, F.struct("host", "verdict"))).alias("rule"), F.max(~rule).alias("listed"), F.first("path").alias("path"), F.max(F.regexp_count("host", F.lit(r"\.")) + 1).alias("labels"))
    urls = pages.select("url").distinct().filter("url is not null").select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    candidates = keys_of(urls, RULE, F.col("host"), F.col("path"), entries).union(keys_of(urls, LIST, canonical_host(F.col("host")), canonical_path(F.col("path")), entries))
    hits = possible(candidates, entries.select("key")).join(entries.select("key", "rule", "listed"), "key").withColumn("key", F.substring("key", 3, 1 << 30))
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("key").alias("n"), F.length("rule.host").alias("h"), "key", "rule.verdict")))
    decided = hits.groupBy("url").agg(best.alias("best"), F.max("listed").alias("listed"))
    decided = decided.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = pages.select("page_id", "url", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt")).join(decided, ["url", "salt"], "left")
    listed = F.coalesce("listed", F.lit(False))
    verdict = F.coalesce("best.verdict", F.when(listed, "block").otherwise("allow"))
    return out.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("best.key").alias("rule"), verdict.alias("verdict"), listed.alias("listed"))


def oracle(rules=RULES, listed=LISTED) -> str:
    """DuckDB SQL for judge_urls() over pages."""
    rows = lambda x: ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in x)
    fits = lambda h, p: f"({h} = e.host OR ends_with({h}, '.' || e.host)) AND starts_with({p}, e.path)"
    return f"""
WITH parsed AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, host, path) AS (VALUES {rows(rules)}),
listing(host, path) AS (VALUES {rows(listed)})
SELECT page_id, host, path, best.key AS rule, coalesce(best.verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM (
  SELECT p.page_id, p.host, p.path,
         (SELECT max(struct_pack(n := length(e.host || e.path), h := length(e.host), key := e.host || e.path, verdict := e.verdict)) FROM rules e WHERE {fits('p.host', 'p.path')}) AS best,
         EXISTS (SELECT 1 FROM listing e WHERE {fits('p.chost', 'p.cpath')} AND p.host <> '') AS listed
  FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^[\\s\\S]*@', ''), ':[0-9]*$', ''), '\\.+$', '') AS chost,
               CASE WHEN path = '' THEN '/' ELSE url_decode(replace(path, '+', '%2B')) END AS cpath FROM parsed) p)"""
