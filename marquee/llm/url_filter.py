"""URL filter: prefix rules first, then a blocked Bloom filter of listed canonical URLs and an exact hash join.

The filter is a table of blocks. A URL's first hash picks one block of 512 bits (eight longs), a second one sets one bit
in each long, so a probe reads one row. URLs whose bits are all set go on to the exact join, which removes the false
positives; all others are decided without it. The block table is broadcast only if it has at most
``BROADCAST_BLOCKS`` blocks (72 bytes each); a longer list is probed by a shuffled join on the block.

A null url, or one without ``://``, has an empty host and an empty path, fits no rule and is allowed. Repeated rows give
repeated rows. An empty list allows whatever no rule decides. Nulls in the list are ignored. Other columns pass through
unless they bear the name of an output column; then the output replaces them.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import saved

WORDS, BITS_PER_URL, BROADCAST_BLOCKS, HOT = 8, 16, 500_000, 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?>[\s\S]*?://)[^/?#]*(/[^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without a leading www. or m. and path without a final slash or .html; scheme, query and fragment go."""
    return F.concat(F.regexp_replace(host(url), r"^(www|m)\.", ""), F.regexp_replace(path(url), r"(\.html|/)$", ""))


def rule_of(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host_ == h) | host_.endswith(f".{h}")) & path_.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _hashes(url: Column, blocks: int) -> list[Column]:
    bits = F.xxhash64(url, F.lit(7))
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]
    return [F.pmod(F.xxhash64(url), F.lit(blocks)).alias("block"), *(m.alias(f"m{i}") for i, m in enumerate(masks))]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """block, w0..w7 of the blocks that have bits; listed has one column, url."""
    return listed.select(*_hashes(F.col("url"), blocks)).groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)))


def listed_urls(urls: DataFrame, listed: DataFrame, bits: int = BITS_PER_URL) -> DataFrame:
    """The distinct canonical urls of urls(url) that are among listed(url)."""
    listed = listed.select("url").where("url IS NOT NULL").distinct()
    blocks = max(1, -(-listed.count() * bits // (64 * WORDS)))
    table = bloom_blocks(listed, blocks)
    probes = urls.select("url").where("url IS NOT NULL").distinct().select("url", *_hashes(F.col("url"), blocks))
    possible = probes.join(F.broadcast(table) if blocks <= BROADCAST_BLOCKS else table, "block").where(
        functools.reduce(operator.and_, [F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) != 0 for i in range(WORDS)])
    )
    return possible.select("url").join(listed.hint("shuffle_hash"), "url", "left_semi")


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """pages(url, ...) with host, path, rule and verdict; listed(url) holds canonical urls to block.

    Rows that a rule decides join nothing. Canonical urls that make up more than a ``HOT``-th of the other rows, fewer than
    ``HOT`` by that, are judged by a broadcast join; the rest are joined by url.
    """
    names = {"host", "path", "rule", "verdict"}
    fields = [c for c in pages.columns if c.lower() not in names]
    kept = F.struct(*fields).alias("row")
    base = pages.select(kept, host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), canonical(F.col("url")).alias("canon")).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    undecided = base.where("fit IS NULL")
    counts = saved(undecided.groupBy("canon").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hits = saved(listed_urls(counts.select(F.col("canon").alias("url")), listed).select(F.col("url").alias("canon"), F.lit(True).alias("hit")))
    hot = counts.where(F.col("n") * HOT > total).join(hits, "canon", "left").select("canon", F.coalesce("hit", F.lit(False)).alias("known"))

    def out(frame: DataFrame, hit: Column) -> DataFrame:
        verdict = F.coalesce("fit.verdict", F.when(hit, "block").otherwise("allow"))
        return frame.select("row.*", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))

    ruled = out(base.where("fit IS NOT NULL"), F.lit(False))
    if not total:
        return ruled
    common = out(undecided.join(F.broadcast(hot), "canon"), F.col("known"))
    rest = out(undecided.join(F.broadcast(hot), "canon", "left_anti").join(hits, "canon", "left"), F.col("hit"))
    return ruled.unionByName(common).unionByName(rest)
