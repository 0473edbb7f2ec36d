"""N-gram Jaccard self-join by rare-first prefix filtering.

Each text is the set of its distinct five-word shingles (A-Z lowered). Texts with equal sets form a class, which enters
the join once. Shingles are ordered rare first by a count over all documents, kept in ``BUCKETS`` hashed counters (any
order gives right results, a rare-first one gives few candidates), and each class is listed under the first
``n - ceil(0.75 n) + 1`` of them. The smaller class of a linked pair has a shared shingle among its first
``n - ceil(6 n / 7) + 1`` already; those rows are its index rows. Classes that share a listed shingle, an index row of the
smaller one, are candidates if the length and positional filters let them pass; a suffix filter and then the exact overlap
of the whole sets decide, once a pair.

Of the shingles that list exactly the same classes only the first in the order stays: the first shingle that two classes
share is the one at which they must meet, and it is never the later one of such shingles.

Groups of classes under one shingle are never paired all with all. A round compares each class with the pivots of its group;
then groups in which nothing across components is left are done. Rounds repeat until the pairs left over all groups are at
most ``SPARE`` times the listed shingles; those are compared by the filters within one join. So a group of many near copies collapses after a round
or two and the rest stays in proportion to the input. No pair across components is left untested.

Null, empty and blank texts have an empty set, are linked with nothing and are their own component. Texts with fewer
than five words have their whole word sequence as one shingle. Rows that repeat a doc_id are each scored and then share
the component of the least linked one. A null doc_id gets a null component and links nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import block_words, discard, giving_back, grams, mix, saved, small_batches, text_blocks
from marquee.llm.components import components

SHINGLE, THRESHOLD, BUCKETS, SPARE = 5, 0.75, 1 << 16, 256
#: Class ids are broadcast up to this many (16 MB).
BROADCAST_IDS = 1_000_000
BANDS = 5  # a doubling of the size
_SHIFT = np.uint64(48)
_SHORT = np.uint64(0xE7037ED1A0B428DB)


def _sets(column, k: int):
    """(row, sorted distinct shingle hashes) of every text of a string column."""
    for first, data, offsets in text_blocks(column):
        _, _, hashes, bounds = block_words(data, offsets, lower=True)
        gram = grams(hashes, k)
        for i in range(len(offsets) - 1):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= k:
                yield first + i, np.unique(gram[a : b - k + 1])
            elif b > a:
                yield first + i, mix(grams(hashes[a:b], b - a) ^ (np.full(1, b - a, np.uint64) * _SHORT))
            else:
                yield first + i, np.zeros(0, np.uint64)


def _identity(x: np.ndarray) -> int:
    """A hash of the whole set."""
    return int(mix(mix(x ^ _SHORT).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(x)))[0].view(np.int64))


def _scan(k: int):
    """Rows of documents (bucket null) and counts of hashed shingles (doc_id null)."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            n, cid, waiting = [], [], []
            for _, x in _sets(batch.column("text"), k):
                n.append(len(x))
                cid.append(_identity(x))
                waiting.append((x >> _SHIFT).astype(np.int32))
                if len(waiting) == 1000:
                    counts += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
                    waiting = []
            if waiting:
                counts += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.nulls(len(n), pa.int32())], ["doc_id", "n", "cid", "bucket"])
        at = np.flatnonzero(counts)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(counts[at]), none, pa.array(at.astype(np.int32))], ["doc_id", "n", "cid", "bucket"])

    return run


def prefix_length(n: int, threshold: float = THRESHOLD) -> int:
    return n - -(-n * round(threshold * 100) // 100) + 1


def band_reach(threshold: float = THRESHOLD) -> int:
    """So many bands apart are two classes that can be linked at most."""
    return math.ceil(BANDS * math.log2(1 / threshold))


def _prefixes(k: int, counts: np.ndarray, threshold: float):
    """token, cid, n and pos of the shingles that each set is listed under."""

    def put(rows):
        token, cid, n = (np.concatenate([r[i] for r in rows]) for i in range(3))
        pos = np.concatenate([np.arange(len(r[0]), dtype=np.int32) for r in rows])
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(cid), pa.array(n), pa.array(pos)], ["token", "cid", "n", "pos"])

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for _, x in _sets(batch.column("text"), k):
                if len(x):
                    p = prefix_length(len(x), threshold)
                    first = x[np.argsort(counts[(x >> _SHIFT).astype(np.int64)], kind="stable")[:p]]
                    rows.append((first, np.full(p, _identity(x)), np.full(p, len(x), np.int32)))
                    size += p
                if size > 50_000:
                    yield put(rows)
                    rows, size = [], 0
            if rows:
                yield put(rows)

    return run


def _own(k: int):
    """Of rows that share a doc_id, the text that the class stands for."""

    def run(batches):
        for batch in batches:
            cid = batch.column("cid").to_numpy()
            keep = [i for i, x in _sets(batch.column("text"), k) if _identity(x) == cid[i]]
            if keep:
                yield batch.take(pa.array(keep))

    return run


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """At most so many values are common to two sorted sets: both are split at the middle of one, down to depth."""
    if not len(x) or not len(y):
        return 0
    if depth == 0:
        return min(len(x), len(y))
    mid = x[len(x) // 2]
    a, b = len(x) // 2, int(np.searchsorted(y, mid))
    return suffix_bound(x[:a], y[:b], depth - 1) + suffix_bound(x[a:], y[b:], depth - 1)


def _verify(k: int, percent: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            keep = []
            last: tuple[int, np.ndarray] | None = None
            texts = batch.column("text_b")
            for i, x in _sets(batch.column("text_a"), k):
                if last is None or last[0] != b[i]:
                    last = (b[i], next(_sets(texts.slice(i, 1), k))[1])
                y = last[1]
                need = -(-percent * (len(x) + len(y)) // (100 + percent))
                if suffix_bound(x, y) >= need:
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return run


def _index_row(threshold: float):
    """Whether a class can be the smaller one of a pair whose first common shingle this is."""
    percent = round(threshold * 100)
    return F.expr(f"pos < n - ceil(2 * {percent} * n / {100 + percent}.0D) + 1")


def _passes(threshold: float):
    """Length, index-row and positional filters for two classes (n, pos, index) and (n2, pos2, index2) at a shared shingle."""
    percent = round(threshold * 100)
    need = F.expr(f"ceil({percent} * (n + n2) / {100 + percent}.0D)")
    smaller = ((F.col("n2") <= F.col("n")) & F.col("index2")) | ((F.col("n") <= F.col("n2")) & F.col("index"))
    return smaller & (F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent) & (F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) >= need)


def _check(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The links among pairs(a, b); texts has cid, text of every class that can occur. Texts that no pair needs are left out before the shuffle if the ids fit a broadcast."""
    ids = saved(pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct())
    if ids.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(ids), "cid", "left_semi")
    left = pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return saved(both.mapInArrow(giving_back(_verify(k, percent)), "a long, b long"))


def similar(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, class_id (least doc_id with the same set) and component_id of every row of docs(doc_id, text)."""
    percent = round(threshold * 100)
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scan = saved(docs.mapInArrow(giving_back(_scan(k)), "doc_id long, n long, cid long, bucket int"))
    counts = np.zeros(BUCKETS, np.int64)
    for r in scan.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        counts[r.bucket] = r.n
    rows = scan.where("bucket IS NULL").drop("bucket")
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("class_id"))

    listed = saved(docs.where("doc_id IS NOT NULL").mapInArrow(giving_back(_prefixes(k, counts, threshold)), "token long, cid long, n int, pos int"))
    several = listed.groupBy("token").agg(F.count("*").alias("m"), F.max(_index_row(threshold)).alias("any")).where("m > 1 AND any").select("token")
    shared = saved(listed.join(several, "token").groupBy("token", "cid").agg(F.first("n").alias("n"), F.first("pos").alias("pos")))
    discard(listed)
    shared = saved(_distinct_groups(shared))
    involved = shared.select("cid").distinct().join(classes, "cid").select("cid", F.col("class_id").alias("doc_id"))
    texts = saved(docs.join(involved, "doc_id").select("cid", "text").mapInArrow(giving_back(_own(k)), "cid long, text string"))
    stars = _stars(shared, texts, threshold, k)

    out = rows.join(classes, "cid", "left").join(stars, F.col("cid") == F.col("node"), "left")
    ids = classes.join(stars, F.col("cid") == F.col("node")).groupBy("component").agg(F.min("class_id").alias("component_id"))
    class_id = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")))
    return out.join(ids, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), class_id.alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", class_id)).alias("component_id"))


def _distinct_groups(shared: DataFrame) -> DataFrame:
    """shared without shingles that list one class only, or the same classes as an earlier one; times tells for how many a shingle stands."""
    marks = [F.bit_xor(F.xxhash64("cid", F.lit(i))).alias(f"mark{i}") for i in range(2)]  # each class is listed once a shingle
    groups = shared.groupBy("token").agg(F.count("*").alias("m"), *marks, F.min(F.struct("cid", "pos")).alias("least"))
    firsts = groups.where("m > 1").groupBy("m", "mark0", "mark1").agg(F.min(F.struct("least", "token")).alias("first"), F.count("*").alias("times"))
    return shared.join(firsts.select(F.col("first.token").alias("token"), "times"), "token")


def _stars(shared: DataFrame, texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """node, component of every class that is linked with another."""
    spark, percent = shared.sparkSession, round(threshold * 100)
    size = shared.count()
    stars = spark.createDataFrame([], "node long, component long")
    tested = spark.createDataFrame([], "a long, b long")
    # The class with most shared shingles is the pivot: what near copies were made from shares more than they do.
    degree = shared.groupBy("cid").agg(F.sum("times").alias("degree"))
    live = shared.drop("times").join(degree, "cid").withColumns({"component": F.col("cid"), "index": _index_row(threshold), "band": F.floor(F.log2("n") * BANDS).cast("int")})
    for turn in range(size):
        members = live.groupBy("token", "component").agg(F.count("*").alias("c"), F.count_if("index").alias("i"))
        sums = [F.sum("c").alias("m"), F.sum("i").alias("i"), F.sum(F.col("c") * F.col("i")).alias("within"), F.max(F.struct("c", "component")).alias("top")]
        group = members.groupBy("token").agg(*sums).withColumn("left", F.expr("m * i - within")).where("left > 0")
        groups = saved(group.select("token", "left", F.col("top.component").alias("main")))
        left = groups.agg(F.sum("left")).first()[0]
        if not left:
            break
        last = turn > 1 and left <= SPARE * size
        live = live.join(groups.select("token", "main"), "token")
        # Four pivots for each band of sizes, so that a group of near copies meets some of its own kind: the class with most shared
        # shingles and three by hash, which differ from shingle to shingle. Rows meet the pivots of every band that a linked class
        # can be in, so a pivot has met all that it can be linked with and leaves its group.
        row = F.struct("cid", "n", "pos", "component", "index")
        best = [F.max(F.struct("index", key, row.alias("row")))["row"] for key in ("degree", *(F.xxhash64("token", "cid", F.lit(i)).alias("h") for i in range(3)))]
        pivots = live.groupBy("token", "band").agg(F.array_distinct(F.array(*best)).alias("p")).select("token", "band", F.explode("p").alias("p")).select("token", "band", "p.*")
        other = live.where("component <> main") if last else pivots
        other = other.select(F.col("token").alias("token2"), *(F.col(c).alias(f"{c}2") for c in ("cid", "n", "pos", "component", "index", "band")))
        once = (F.col("component") == F.col("main")) | (F.col("cid") < F.col("cid2")) if last else F.abs(F.col("band") - F.col("band2")) <= band_reach(threshold)
        found = live.join(other, (F.col("token") == F.col("token2")) & once & (F.col("component") != F.col("component2")) & _passes(threshold))
        pairs = found.select(F.greatest("cid", "cid2").alias("a"), F.least("cid", "cid2").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        pairs = saved(pairs)
        links = _check(pairs, texts, k, percent)
        stars = components(stars.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))
        if last:
            break
        tested = tested.unionByName(pairs)
        rest = live.join(pivots.select("token", "cid"), ["token", "cid"], "left_anti").drop("component", "main")
        live = saved(rest.join(stars, F.col("cid") == F.col("node"), "left").select("token", "cid", "n", "pos", F.coalesce("component", "cid").alias("component"), "index", "degree", "band"))
    return stars


def brute_force(rows: list[tuple[int, str | None]], percent: int = 75, k: int = SHINGLE) -> dict[int, tuple[int, int]]:
    """n_shingles and component_id of few rows by definition, for tests."""
    import re

    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    where: dict[tuple, list[int]] = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    root = {d: d for d in sets}

    def top(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    for d, s in sets.items():
        for e in {e for x in s for e in where[x] if e < d}:
            c = len(s & sets[e])
            if 100 * c >= percent * (len(s) + len(sets[e]) - c):
                a, b = sorted((top(d), top(e)))
                root[b] = a
    return {d: (len(s), top(d)) for d, s in sets.items()}
