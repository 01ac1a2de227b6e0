"""URL filter: prefix rules, then a listing behind a blocked Bloom filter.  DataFrame functions only.

The listed canonical URLs fill a Bloom filter of 64-bit blocks: a URL's hash chooses one block and, in it, a few bits, so
a probe reads one word.  The blocks come from one ``bit_or`` aggregation and travel as pages of 1,024 words.  Their number
is a power of two up to ``MOST_BLOCKS``, so the broadcast is 64 MB at most, which serves 33 million listed URLs at 16 bits
each; a longer listing raises the rate of false positives, and with it the rows of the exact join, but never changes a
verdict.  Rows whose bits are not all set are done without any shuffle.  The others go to an exact hash join on the
canonical URL, which removes the false positives; only they are shuffled, and a hot URL is split by adaptive execution,
since the listing holds each URL once.  The table is read once for each of the two ways: one outer join for all rows would
read it once and shuffle it whole.

Null URLs, and URLs without ``://``, have an empty host and path, no rule and no listing entry: they are allowed.  URLs of
any length are read whole.  Repeated rows are judged each; an empty table gives no rows, an empty listing blocks nothing.
Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS_PER_URL = 16
PROBES = 6
PAGE_BITS = 10
MOST_BLOCKS = 1 << 23  # of 64 bits: a broadcast of 64 MB


@dataclass(frozen=True)
class Rule:
    """A host (with all its subdomains) and a path prefix."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(common.ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One form for the spellings of a URL: no scheme, port, ``www.`` or ``m.``, query, fragment, or ending slash or page suffix."""
    bare = F.regexp_replace(F.regexp_replace(host, r":\d*$", ""), r"^(www|m)\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(F.regexp_replace(path, r"(\.html?|/index\.html?)$", ""), r"/+$", "")))


def rule_of(rules: list[Rule], host: Column, path: Column, attribute: str) -> Column:
    """``attribute`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the last one asked is the longest
        fits = (host == rule.host) | host.endswith("." + rule.host)
        out = F.when(fits & path.startswith(rule.path), F.lit(getattr(rule, attribute))).otherwise(out)
    return out


def block_count(listed: int, bits_per_url: int = BITS_PER_URL, most: int = MOST_BLOCKS) -> int:
    """The power of two of 64-bit blocks for so many URLs, ``most`` at most."""
    need = max(1, math.ceil(listed * bits_per_url / 64))
    return min(most, 1 << (need - 1).bit_length())


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int")


def _mask(url: Column, probes: int) -> Column:
    """The bits of a URL in its block, from a second hash: six bits of it choose each."""
    second = F.xxhash64(url, F.lit(7))
    mask = F.lit(0).cast("long")
    for k in range(probes):
        bit = F.shiftrightunsigned(second, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def bloom_pages(listed: DataFrame, blocks: int, probes: int = PROBES) -> DataFrame:
    """``(page, words)`` of the filter of the canonical URLs in column ``url``: the words of 1,024 blocks in order."""
    filled = listed.where(F.col("url").isNotNull()).select(_block(F.col("url"), blocks).alias("block"), _mask(F.col("url"), probes).alias("mask"))
    bare = listed.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"), F.lit(0).cast("long").alias("mask"))
    words = filled.union(bare).groupBy("block").agg(F.bit_or("mask").alias("word"))
    pages = words.groupBy(F.shiftright("block", PAGE_BITS).alias("page")).agg(F.array_sort(F.collect_list(F.struct("block", "word"))).alias("w"))
    return pages.select("page", F.transform("w", lambda x: x["word"]).alias("words"))


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, host, path, rule, verdict of each row: the rule's verdict, else block if the canonical URL is listed.

    ``listed`` has canonical URLs in column ``url``, repeats and nulls allowed.
    """
    listed = common.written(listed.where(F.col("url").isNotNull()).select("url").distinct(), "listed")
    blocks = block_count(listed.count())
    # eight bytes for each of a bounded number of blocks
    bloom = F.broadcast(bloom_pages(listed, blocks))
    host, path = F.col("host"), F.col("path")
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.select("id", "host", "path", rule_of(rules, host, path, "text").alias("rule"), rule_of(rules, host, path, "verdict").alias("by_rule"), canonical(host, path).alias("url"))
    rows = rows.withColumn("block", F.when(F.col("rule").isNull(), _block(F.col("url"), blocks)))
    rows = rows.withColumn("page", F.shiftright("block", PAGE_BITS))
    probed = rows.join(bloom, "page", "left").withColumn("mask", _mask(F.col("url"), PROBES))
    probed = probed.withColumn("word", F.element_at("words", F.col("block").bitwiseAND(F.lit((1 << PAGE_BITS) - 1)) + 1))
    possible = F.coalesce(F.col("rule").isNull() & (F.col("word").bitwiseAND(F.col("mask")) == F.col("mask")), F.lit(False))
    probed = probed.withColumn("possible", possible)
    done = probed.where(~F.col("possible")).select("id", "host", "path", "rule", F.coalesce("by_rule", F.lit("allow")).alias("verdict"))
    hits = probed.where("possible").select("id", "host", "path", "rule", "url")
    exact = hits.join(listed.withColumn("found", F.lit(True)), "url", "left")
    exact = exact.select("id", "host", "path", "rule", F.when(F.col("found"), "block").otherwise("allow").alias("verdict"))
    return done.unionByName(exact).withColumnRenamed("id", id_col)
