"""Fixity audit of archive replicas by Merkle trees.

A record's leaf is the SHA-256 of its bytes, a node's digest the SHA-256 of its at most ``FAN_OUT`` children's digests, each
with its key, in order. Keys are ranges of record ids, which are also the order of offsets: a file holds ``RECORDS_PER_FILE``
ids, a leaf stands at its id's place within the file, and above files nodes join ordered ranges of file numbers. So a record
that one replica lacks leaves its place empty and moves no other record into another node. The audit compares the replicas'
roots and reads, level by level, only the children of nodes that differ, down to the records. Every node carries the range
of offsets that its records span in its replica.

A record that one replica lacks is named missing or extra, one whose bytes differ damaged. Null html is an empty body, a null
url an empty one. Records without a page_id are dealt by their digest to ``STRAY_FILES`` files of their own, numbered from -1
down. Rows that repeat a page_id (or share the place of a stray) are numbered in the order of their digests and compared in
that order. Two empty replicas agree. Other columns of the pages are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import saved

FAN_OUT, RECORDS_PER_FILE, STRAY_FILES = 16, 1000, 1024


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC resource record as text."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def leaves(records: DataFrame) -> DataFrame:
    """file, place, nth, ord, page_id, offset, length and digest of records(page_id, record): 1000 page_ids a file, in order."""
    digest = F.sha2("record", 256)
    stray = -1 - F.pmod(F.crc32(digest.cast("binary")), F.lit(STRAY_FILES))
    file = F.coalesce(F.floor(F.col("page_id") / RECORDS_PER_FILE), stray).cast("long")
    hashed = records.select("page_id", file.alias("file"), F.coalesce(F.pmod("page_id", F.lit(RECORDS_PER_FILE)), F.lit(0)).cast("long").alias("place"), F.octet_length("record").cast("long").alias("length"), digest.alias("digest"))
    order, same = Window.partitionBy("file").orderBy("page_id", "digest"), Window.partitionBy("file", "page_id").orderBy("digest")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hashed.select("file", "place", (F.row_number().over(same) - 1).cast("long").alias("nth"), (F.row_number().over(order) - 1).cast("long").alias("ord"), "page_id", (F.sum("length").over(before) - F.col("length")).alias("offset"), "length", "digest")


#: A node's key, from the outermost part to the innermost; a level above divides the innermost part that isn't 0 everywhere.
KEY = ["file", "place", "nth"]


def _up(part: str) -> list[Column]:
    """The key of a node's parent, one level up in part."""
    at = KEY.index(part)
    whole = F.floor(F.col(part) / FAN_OUT).cast("long")
    return [F.col(k) if i < at else whole.alias(k) if i == at else F.lit(0).cast("long").alias(k) for i, k in enumerate(KEY)]


def tree(both: DataFrame) -> list[tuple[DataFrame, str]]:
    """The levels of the replicas' trees, leaves first, as (replica, file, place, nth, digest, start, stop) and the part of the key that the next level divides; the last has one node a replica and sign of file."""
    level = both.select("replica", *KEY, "digest", F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("stop"))
    tops = level.agg(F.max("nth"), F.max("place"), F.greatest(F.max("file"), -F.min("file"))).first()
    levels = []
    for part, top in zip(reversed(KEY), tops, strict=True):
        top = top or 0
        while top > (1 if part == "file" else 0):  # floors of negative file numbers end at -1
            levels.append((level, part))
            parents = level.select("replica", *_up(part), F.struct(*KEY, "digest").alias("kid"), "start", "stop").groupBy("replica", *KEY)
            joined = parents.agg(F.sha2(_listed(F.collect_list("kid")), 256).alias("digest"), F.min("start").alias("start"), F.max("stop").alias("stop"))
            level = saved(joined)
            top //= FAN_OUT
    return [*levels, (level, "")]


def _listed(kids: Column) -> Column:
    """The keys and digests of at most FAN_OUT children, in order."""
    return F.array_join(F.transform(F.array_sort(kids), lambda c: F.concat_ws(":", *(c[k].cast("string") for k in KEY), c["digest"])), ",")


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """file, place, nth, digest_a, digest_b and the offset ranges start_a, stop_a, start_b, stop_b of every leaf that differs between two replicas' leaves()."""
    both = saved(a.withColumn("replica", F.lit("a")).unionByName(b.withColumn("replica", F.lit("b"))))
    open_ = None
    for level, part in reversed(tree(both)):
        if open_ is not None:
            up = level.select("*", *(c.alias(f"up_{k}") for k, c in zip(KEY, _up(part), strict=True)))
            level = up.join(open_.select(*(F.col(k).alias(f"up_{k}") for k in KEY)), [f"up_{k}" for k in KEY], "left_semi")
        sides = level.groupBy(*KEY).agg(*(F.max(F.when(F.col("replica") == r, F.col(c))).alias(f"{c}_{r}") for r in "ab" for c in ("digest", "start", "stop")))
        open_ = saved(sides.where("NOT (digest_a <=> digest_b)"))
    return open_


def report(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every record of either replica with its place in its file (in a, or else in b), digests and status: ok, damaged, missing (from b) or extra (in b)."""
    bad = audit(a, b).select(*KEY, F.lit(True).alias("bad"))
    names = ["ord", "page_id", "offset", "length", "digest"]
    sides = a.select(*KEY, *names).join(b.select(*KEY, *(F.col(c).alias(f"{c}_b") for c in names)), KEY, "full")
    status = F.when(F.col("bad").isNull(), "ok").when(F.col("digest_b").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("damaged")
    out = sides.join(bad, KEY, "left")
    return out.select("file", *(F.coalesce(c, f"{c}_b").alias(c) for c in names[:-1]), "digest", F.col("digest_b").alias("replica_digest"), status.alias("status"))
