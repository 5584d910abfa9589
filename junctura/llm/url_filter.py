"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join of the possible hits.

A listed entry is a rule (action, host, path): it fits its host and all subdomains, if the URL's path starts with
the rule's. Its canonical form is host || path. A URL's possible hosts are the ends of its host at dots, at most as many labels
as a listed host has; those in the list are looked up together with the lengths of their listed paths, and each gives the canonical URLs
to test. The list's Bloom filter is an array of
64-bit blocks; an entry sets four bits of one block. Keys whose bits are all set are joined to the list, and that hash join
removes false positives; of several hits the longest wins. A filter of the listed hosts stands before their look-up, too. All of it is DataFrame functions,
and its work does not grow with the number of different lengths in the list.

The filter has at most MOST_BLOCKS blocks (8 MB), whatever the list; a list too long for it passes more keys to the
join, which stays exact. The list itself is broadcast up to BROADCAST_RULES entries (counted), else hashed by key.

Defined cases: a null URL or one without "://" has an empty host and path; a URL without a hit gets the default verdict;
of equally long hits the smaller string wins, and of equal entries the smaller action; repeated rows are judged each; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BLOCKS, BROADCAST_RULES, BITS = 1 << 20, 100_000, 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules(spark: SparkSession, listed: list[tuple[str, str, str]]) -> DataFrame:
    """A table of rules from (action, host, path) tuples, as SQL VALUES (its size is known to the planner)."""
    quoted = ", ".join("(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in rule) + ")" for rule in listed)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t(action, host, path)")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    bits = F.xxhash64(key, F.lit(1))
    out = F.lit(0).cast("long")
    for i in range(BITS):
        bit = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return out


def bloom_filter(spark: SparkSession, keys: DataFrame, count: int) -> tuple[DataFrame, int]:
    """One row with the filter's blocks as an array, and how many there are."""
    blocks = min(MOST_BLOCKS, max(64, 1 << (count - 1).bit_length() if count else 64))
    masks = keys.select(_block(F.col("key"), blocks).alias("block"), _mask(F.col("key")).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("mask"))
    all_blocks = spark.range(blocks).select(F.col("id").cast("int").alias("block"))
    dense = all_blocks.join(masks, "block", "left").select("block", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "mask"))), lambda x: x["mask"]).alias("filter")), blocks


def possible(key: Column, filter_row: DataFrame, blocks: int) -> Column:
    """Whether a key's bits are all set in a filter of bloom_filter()."""
    mask = _mask(key)
    return F.get(filter_row.scalar(), _block(key, blocks)).bitwiseAND(mask) == mask


def judged(spark: SparkSession, pages: DataFrame, listed: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (the longest that fits, else null) and verdict of every page."""
    listed = listed.select("action", "host", "path").where("host is not null and path is not null")
    hosts = listed.groupBy(F.col("host").alias("end")).agg(F.collect_set(F.length("path")).alias("lengths"))
    found = listed.agg(F.count("*").alias("n"), F.countDistinct("host").alias("hosts"), F.max(F.size(F.split("host", r"\."))).alias("labels")).first()
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    if not found["n"]:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    sized = lambda df, n: F.broadcast(df) if n <= BROADCAST_RULES else df.hint("shuffle_hash")
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - found["labels"] + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    by_end = urls.select("page_id", "url", "path", F.explode(ends).alias("end"))
    by_end = by_end.where(possible(F.col("end"), *bloom_filter(spark, hosts.select(F.col("end").alias("key")), found["hosts"])))
    lengths = F.filter("lengths", lambda n: n <= F.length("path"))
    keys = by_end.join(sized(hosts, found["hosts"]), "end").select("page_id", "url", "end", "path", F.explode(lengths).alias("n")).select("page_id", "url", "end", F.substr("path", F.lit(1), F.col("n")).alias("start"))
    passed = keys.where(possible(F.concat("end", "start"), *bloom_filter(spark, listed.select(F.concat("host", "path").alias("key")), found["n"])))
    entries = sized(listed.select(F.col("host").alias("end"), F.col("path").alias("start"), "action"), found["n"])
    rule = F.concat("end", "start")
    best = F.min(F.struct((-F.length(rule)).alias("length"), rule.alias("rule"), "action")).alias("best")
    hits = passed.join(entries, ["end", "start"]).groupBy(F.col("page_id").alias("hit_id"), F.col("url").alias("hit_url")).agg(best)
    joined = urls.join(hits, F.col("page_id").eqNullSafe(F.col("hit_id")) & (F.col("url") == F.col("hit_url")), "left")
    return joined.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
