"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles, and each partition has its own signature length: the least hash values
of an item, n - ceil(0.75 n) + 1 of them for the largest n of the partition (all of an item's, if it has fewer). A
document that contains three quarters of an item's shingles contains at least one of these, whatever the document's length,
so the search misses nothing. Documents that hold a signature value are candidates for its item; exact containment of the
item's distinct shingles decides.

Shingles are five words (A-Z lowered); a shorter item is one shingle of its words and is searched for with that width.
The documents are first probed for the signature values only; whole shingles are fetched and compared only of the documents
that are candidates. Everything is built-in column functions, joins and aggregates. Signatures, shingles and candidates are
broadcast only if there are at most ``BROADCAST_SHINGLES``; more are joined by shuffles. A signature value that very many
documents hold costs one row a document and item, never a pair of documents.

Null, empty and blank texts contain nothing; items without words are in no document. Repeated item rows and repeated
document rows give one result a distinct (doc_id, item_id): the shingles of rows that share an id are one set. Rows
without an id are left out. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import saved, words

WIDTH, CONTAINMENT, BROADCAST_SHINGLES = 5, 0.75, 500_000
#: Upper ends of the size partitions, in shingles; sizes beyond the last double from one partition to the next.
SIZES = [8, 16, 32, 64, 128, 256, 512, 1024]


def shingles(frame: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """(key, shingle) of every place in a text; a text with fewer words than width has none."""
    word = words(F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    listed = frame.select(key, word.alias("__w")).where(F.size("__w") >= width)
    n = F.size("__w") - (width - 1)
    zipped = F.arrays_zip(*(F.slice("__w", F.lit(i + 1), n).alias(f"w{i}") for i in range(width)))
    parts = listed.select(key, F.explode(zipped).alias("__s")).select(key, *(F.col(f"__s.w{i}").alias(f"w{i}") for i in range(width)))
    return parts.select(key, F.xxhash64(F.lit(width), *(f"w{i}" for i in range(width))).alias("shingle"), F.xxhash64(*(f"w{i}" for i in reversed(range(width))), F.lit(width)).alias("second"))


def item_shingles(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, width, shingle, second and n (the item's distinct shingles)."""
    items = items.where("item_id IS NOT NULL").select("item_id", "text")
    size = F.size(words(F.col("text")))
    out = None
    for w in range(1, width + 1):
        some = items.where(size >= width if w == width else size == w)
        part = shingles(some, "item_id", "text", w).withColumn("width", F.lit(w))
        out = part if out is None else out.unionByName(part)
    out = saved(out.distinct())
    return out.join(out.groupBy("item_id").agg(F.count("*").alias("n")), "item_id")


def signature_length(n: Column, containment: float = CONTAINMENT) -> Column:
    """The signature length of the size partition of an item with n shingles."""
    top = F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double"))))
    for size in reversed(SIZES):
        top = F.when(n <= size, size).otherwise(top)
    return (top - F.ceil(top * containment) + 1).cast("int")


def contained(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, width: int = WIDTH) -> DataFrame:
    """doc_id, item_id, shared, n_shingles and containment of every pair with at least that containment."""
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = saved(item_shingles(items, width))
    counts = {r.width: r.n for r in known.groupBy("width").agg(F.count("*").alias("n")).collect()}  # a row for each width
    if not counts:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, shared long, n_shingles long, containment double")
    ranked = known.groupBy("item_id", "width").agg(F.sort_array(F.collect_set("shingle")).alias("all"), F.max("n").alias("n"))
    signed = ranked.select("item_id", "width", F.explode(F.slice("all", F.lit(1), F.least(signature_length(F.col("n"), containment), F.size("all")))).alias("shingle")).distinct()

    def few(frame: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(frame) if rows <= BROADCAST_SHINGLES else frame

    total = sum(counts.values())
    probed = None
    for w in counts:
        part = shingles(docs, "doc_id", "text", w).select("doc_id", "shingle").join(few(signed.where(F.col("width") == w).select("shingle", "item_id"), total), "shingle").select("doc_id", "item_id")
        probed = part if probed is None else probed.unionByName(part)
    candidates = saved(probed.distinct())
    ids = candidates.select("doc_id").distinct()
    some = docs.join(few(ids, ids.count()), "doc_id", "left_semi")
    held = None
    for w in counts:
        mine = known.where(F.col("width") == w).select("item_id", "shingle", "second", "n")
        part = shingles(some, "doc_id", "text", w).join(few(mine, total), ["shingle", "second"]).select("doc_id", "item_id", "shingle", "second", "n")
        held = part if held is None else held.unionByName(part)
    overlap = held.distinct().join(candidates, ["doc_id", "item_id"], "left_semi")
    found = overlap.groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"), F.max("n").alias("n_shingles"))
    return found.withColumn("containment", F.col("shared") / F.col("n_shingles")).where(F.col("shared") * 100 >= F.col("n_shingles") * round(100 * containment))


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], percent: int = 75, width: int = WIDTH) -> set[tuple[int, int, int, int]]:
    """(doc_id, item_id, shared, n_shingles) by definition, for tests."""
    import re

    def split(text: str | None) -> list[str]:
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))

    def sets(w: list[str], k: int) -> set[tuple]:
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    words_of = {d: split(t) for d, t in docs}
    out = set()
    for i, t in items:
        w = split(t)
        k = min(width, len(w))
        if k:
            mine = sets(w, k)
            for d, v in words_of.items():
                common = len(mine & sets(v, k))
                if common * 100 >= len(mine) * percent:
                    out.add((d, i, common, len(mine)))
    return out
