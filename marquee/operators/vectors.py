"""Item vectors: audits, user profiles, exact top-K search and a randomized truncated SVD."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.sources.work import saved

STRATEGIES = ("mean", "positive_mean", "signed", "centered", "positive_weighted")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    return F.when(norm(a) > 1e-12, F.transform(a, lambda x: x.cast("double") / norm(a)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def vector_audit(vectors: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """One row: rows, ids, dimensions, bad_values, bad_norms of vectors(film_id, vec)."""
    bad = F.exists("vec", lambda x: F.isnan(x.cast("double")) | x.isNull())
    off = F.abs(norm(F.col("vec")) - 1) > tolerance
    return vectors.agg(F.count("*").alias("rows_"), F.count_distinct("film_id").alias("ids"), F.count_distinct(F.size("vec")).alias("dimensions"), F.count_if(bad).alias("bad_values"), F.count_if(off).alias("bad_norms"))


def profile_weights(strategy: str) -> tuple[Column, Column]:
    """(weight, share of the divisor) of a rating; centered needs column user_mean."""
    r = F.col("rating")
    if strategy == "mean":
        return F.lit(1.0), F.lit(1.0)
    if strategy == "positive_mean":
        w = F.when(r >= 3.5, 1.0).otherwise(0.0)
        return w, w
    w = {"signed": r - 3.0, "centered": r - F.col("user_mean"), "positive_weighted": F.greatest(r - 3.0, F.lit(0.0))}[strategy]
    return w, (w if strategy == "positive_weighted" else F.abs(w))


def user_profiles(logs: DataFrame, vectors: DataFrame, strategy: str = "positive_weighted") -> DataFrame:
    """user_id and vec (array<double>); users without evidence, or with a vector of no length, have none."""
    rated = logs.where("rating IS NOT NULL").join(vectors.select("film_id"), "film_id", "left_semi")
    rated = rated.withColumn("user_mean", F.avg("rating").over(Window.partitionBy("user_id"))) if strategy == "centered" else rated
    w, share = profile_weights(strategy)
    first = vectors.select(F.size("vec").alias("n")).first()
    if first is None:
        return rated.select("user_id", F.array().cast("array<double>").alias("vec"))  # no rows
    # Ratings are shuffled by user before they meet their vectors; one sum a dimension, no row per rating and dimension.
    weighed = rated.select("user_id", "film_id", w.alias("w"), share.alias("share")).where("w <> 0").repartition("user_id").join(vectors, "film_id")
    sums = weighed.groupBy("user_id").agg(F.sum("share").alias("share"), *(F.sum(F.col("w") * F.col("vec")[i].cast("double")).alias(f"s{i}") for i in range(first.n)))
    vec = sums.select("user_id", F.array(*(F.try_divide(F.col(f"s{i}"), F.col("share")) for i in range(first.n))).alias("vec"))
    return vec.where(norm(F.col("vec")) > 1e-12)


#: Scores that a task holds at a time, and groups of them whose greatest ones are compared, for each row of a list.
CELLS, GROUPS = 1 << 19, 4


def near_best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of all finite scores that may be among a row's k best once rounded to six places, and few others, in order.

    A row has k scores at least as great as the k-th best of its groups' maxima, so only groups are compared with each other.
    """
    n = scores.shape[1]
    wide = max(1, n // (GROUPS * k))
    most = np.maximum.reduceat(scores, np.arange(0, n, wide), axis=1) if wide > 1 else scores
    least = np.partition(most, most.shape[1] - k, axis=1)[:, most.shape[1] - k]
    return np.divmod(np.flatnonzero(scores >= np.maximum(least - 2e-6, np.finfo(float).min)[:, None]), n)


def top_k_lists(queries: DataFrame, items: DataFrame, depth: int, exclude: DataFrame | None = None, query_rows: int = 1024, item_rows: int = 16384, along: DataFrame | None = None) -> DataFrame:
    """user_id, film, score (arrays, best first): the depth films of greatest inner product for every row of queries(user_id, vec).

    Queries and items meet block by block, and no side is broadcast. Each block product hands on a row a query with its depth
    best; these are shuffled and merged only where there is more than one block of items. exclude(user_id, film_id) is left out
    before depth counts: each query carries those of its excluded films that are items into the blocks. Pairs without a finite
    score are left out.

    along is a row a user: the result has exactly these users, those without a vector with null lists, and along's other columns. With
    one block of items these go into the blocks with the user, so that lists aren't shuffled to meet them.
    """

    def blocked(df: DataFrame, key: str, count: int, out: str) -> DataFrame:
        n = F.pmod(F.xxhash64(key), F.lit(1 << 30))
        others = [F.col(c) for c in df.columns if c not in (key, "vec")]
        packed = df.select(F.pmod(n, F.lit(count)).alias("block"), F.struct(F.col(key).cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec"), *others).alias("row"))
        return packed.groupBy("block").agg(F.collect_list("row").alias(out)).select(out)

    items, q = saved(items.select("film_id", "vec")), queries.select("user_id", "vec")
    if exclude is None:
        q = q.withColumn("seen", F.array().cast("array<bigint>"))
    else:
        seen = exclude.join(items.select("film_id"), "film_id", "left_semi").groupBy("user_id").agg(F.collect_set(F.col("film_id").cast("bigint")).alias("seen"))
        q = q.join(seen, "user_id", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<bigint>")))
    item_blocks = max(1, -(-items.count() // item_rows))
    inside = along if item_blocks == 1 else None
    more = [] if inside is None else [(c, t) for c, t in inside.dtypes if c != "user_id"]
    everyone = saved(q if inside is None else q.join(inside, "user_id", "right"))
    q = everyone if inside is None else everyone.where("vec IS NOT NULL")
    blocks = max(1, -(-q.count() // query_rows))
    pairs = blocked(q, "user_id", blocks, "q").crossJoin(blocked(items, "film_id", item_blocks, "i"))

    def best_of(ids_a, x, seen, ids_b, y, rest):
        with np.errstate(invalid="ignore", over="ignore"):
            scores = x @ y.T
        if not np.isfinite(scores.sum()):
            scores[~np.isfinite(scores)] = -np.inf
        owner, film = np.repeat(np.arange(len(ids_a)), seen.value_lengths().to_numpy()), seen.flatten().to_numpy()
        at = np.minimum(np.searchsorted(ids_b, film), len(ids_b) - 1)
        known = ids_b[at] == film
        scores[owner[known], at[known]] = -np.inf
        n, k = scores.shape[1], min(depth, scores.shape[1])
        owner, at = near_best(scores, k)
        score = np.round(scores[owner, at], 6)
        # One whole number tells the order: the score in millionths, then the id.
        order = np.lexsort((np.rint(score * -1e6).astype(np.int64) * n + at, owner))
        owner, at, score = owner[order], at[order], score[order]
        sizes = np.bincount(owner, minlength=len(ids_a))
        keep = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < k
        ends = pa.array(np.concatenate([[0], np.cumsum(np.minimum(sizes, k))]).astype(np.int32))
        lists = (pa.ListArray.from_arrays(ends, pa.array(c[keep])) for c in (ids_b[at], score))
        return pa.RecordBatch.from_arrays([pa.array(ids_a), *lists, *rest], ["user_id", "film", "score", *(c for c, _ in more)])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch.column("q")[i].values, batch.column("i")[i].values
                ids_a, ids_b = a.field("id").to_numpy(), b.field("id").to_numpy()
                x = np.asarray(a.field("vec").flatten()).reshape(len(ids_a), -1)
                y = np.asarray(b.field("vec").flatten()).reshape(len(ids_b), -1)
                by_id, seen = np.argsort(ids_b, kind="stable"), a.field("seen")
                ids_b, y = ids_b[by_id], y[by_id]
                step = max(1, CELLS // len(ids_b))
                for j in range(0, len(ids_a), step):
                    yield best_of(ids_a[j : j + step], x[j : j + step], seen.slice(j, step), ids_b, y, [a.field(c).slice(j, step) for c, _ in more])

    lists = pairs.mapInArrow(run, ", ".join(["user_id bigint, film array<bigint>, score array<double>", *(f"{c} {t}" for c, t in more)]))
    if inside is not None:
        none = [F.lit(None).cast(f"array<{t}>").alias(c) for c, t in (("film", "bigint"), ("score", "double"))]
        return lists.unionByName(everyone.where("vec IS NULL").select("user_id", *none, *(c for c, _ in more)))
    if item_blocks == 1:
        return lists
    both = F.transform(F.arrays_zip("film", "score"), lambda x: F.struct((-x["score"]).alias("s"), x["film"].alias("film")))
    merged = lists.groupBy("user_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(both))), 1, depth).alias("b"))
    merged = merged.select("user_id", F.col("b.film").alias("film"), F.transform("b.s", lambda s: -s).alias("score"))
    return merged if along is None else merged.join(along, "user_id", "right")


def exact_top_k(queries: DataFrame, items: DataFrame, depth: int, exclude: DataFrame | None = None, query_rows: int = 1024, item_rows: int = 16384) -> DataFrame:
    """user_id, film_id, svd_score, svd_rank: ``top_k_lists`` as a row a film."""
    rows = top_k_lists(queries, items, depth, exclude, query_rows, item_rows).select("user_id", F.posexplode(F.arrays_zip("film", "score")).alias("at", "x"))
    return rows.select("user_id", F.col("x.film").alias("film_id"), F.col("x.score").alias("svd_score"), (F.col("at") + 1).cast("bigint").alias("svd_rank"))


#: Ratings and users (which weigh USER ratings each) of a part of the SVD, about.
PART, USER = 1 << 22, 16


def truncated_svd(logs: DataFrame, rank: int = 32, oversample: int = 10, iterations: int = 4, seed: int = 42, part: int = PART) -> DataFrame:
    """film_id and vec (array<double>, unit length): item factors of the user by film matrix of ratings, missing as zero.

    Randomized subspace iteration. The block of rank + oversample numbers a film is a table: a pass sends a film's numbers once to
    each part of the users that has ratings of it; there they meet the part's ratings, are summed by user, then by film, and a row
    a film goes on. Only a square matrix of rank + oversample comes to the driver. Each pass is written to the shared folder, where
    its lineage ends.
    """
    rated = saved(logs.where("rating IS NOT NULL").groupBy("user_id", "film_id").agg(F.max("rating").alias("rating")))
    links = saved(_links(rated, part))
    films = links.groupBy("film_id").agg(F.collect_list("p").alias("parts"))
    wide = min(rank + oversample, rated.select("film_id").distinct().count())
    block = saved(films.select("film_id", "parts", *((F.xxhash64(F.lit(seed), F.lit(i), "film_id") / float(2**63)).alias(f"q{i}") for i in range(wide))))
    for i in range(iterations):
        rows = _passed(links, block)
        block = saved(rows.groupBy("film_id").agg(F.collect_list("p").alias("parts"), *(F.sum(c).alias(c) for c in rows.columns[2:])))
        for _ in range(2 if i == iterations - 1 else 1):  # twice: rounding of the first time matters for the result
            values, turn = np.linalg.eigh(_gram(block))
            keep = values > max(values[-1], 0) * 1e-13
            block = _turned(block, turn[:, keep] / np.sqrt(values[keep]))
    values, turn = np.linalg.eigh(_collected(_passed(links, block, gram=True), len(_numbers(block.columns))))
    return _unit_rows(_turned(block.drop("parts"), turn[:, np.argsort(-values)[:rank]]))


def _links(rated: DataFrame, part: int) -> DataFrame:
    """film_id, p, u, r: the users (by number within part p) that rated a film and their ratings, a row a film and part.

    A part is a range of users with about as many ratings as part says, so that ids that lie together stay together; its number
    comes from sums over ranges, so no task holds all users.
    """
    counts = saved(rated.groupBy("user_id").agg((F.count("*") + USER).alias("n")).repartitionByRange("user_id").withColumn("__r", F.spark_partition_id()))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counts.groupBy("__r").agg(F.sum("n").alias("s")).select("__r", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("before"))  # a row a range
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("__r").orderBy("user_id")) - F.col("n")
    users = counts.join(F.broadcast(sizes), "__r").withColumn("p", F.floor(upto / part).cast("int")).select("user_id", "p", (F.row_number().over(Window.partitionBy("p").orderBy("user_id")) - 1).alias("u"))
    return rated.join(users, "user_id").groupBy("film_id", "p").agg(F.collect_list(F.struct(F.col("u").cast("int").alias("u"), F.col("rating").cast("double").alias("r"))).alias("l")).select("film_id", "p", F.col("l.u").alias("u"), F.col("l.r").alias("r"))


def _passed(links: DataFrame, block: DataFrame, gram: bool = False) -> DataFrame:
    """Each part's share of (ratings' transpose) x (ratings) x block, a row a film; with gram its users' sums as cells of their products."""
    names = _numbers(block.columns)
    n = len(names)

    def run(rated: pa.Table, sent: pa.Table) -> pa.Table:
        # Each film of the part has a row on both sides.
        rated, sent = (t.sort_by("film_id").combine_chunks() for t in (rated, sent))
        lists = rated.column("u").combine_chunks()
        size = lists.value_lengths().to_numpy()
        u, r = lists.flatten().to_numpy(), rated.column("r").combine_chunks().flatten().to_numpy()
        sums = [np.bincount(u, r * np.repeat(sent.column(c).to_numpy(), size)) for c in names]
        if gram:
            m = np.column_stack(sums)
            return pa.table({"cell": np.arange(n * n), "value": (m.T @ m).ravel()})
        starts = np.cumsum(size) - size
        return pa.table({"film_id": rated.column("film_id"), "p": rated.column("p"), **{c: np.add.reduceat(r * s[u], starts) for c, s in zip(names, sums, strict=True)}})

    sent = block.select(F.explode("parts").alias("p"), "film_id", *names)
    out = "cell bigint, value double" if gram else ", ".join([f"film_id {block.dtypes[0][1]}, p int", *(f"{c} double" for c in names)])
    return links.groupBy("p").cogroup(sent.groupBy("p")).applyInArrow(run, out)


def _numbers(columns: list[str]) -> list[str]:
    """The block's columns but those that tell the film and its parts."""
    return [c for c in columns if c not in ("film_id", "parts")]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _numbers(batch.schema.names)])


def _gram(block: DataFrame) -> np.ndarray:
    """The products of all pairs of the block's columns, summed over rows; each partition sends one small matrix."""
    n = len(_numbers(block.columns))

    def run(batches):
        total = np.zeros((n, n))
        for batch in batches:
            m = _matrix(batch)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * n)), pa.array(total.ravel())], ["cell", "value"])

    return _collected(block.mapInArrow(run, "cell bigint, value double"), n)


def _collected(cells: DataFrame, n: int) -> np.ndarray:
    """cells(cell, value), summed by cell, as a square matrix."""
    out = np.zeros(n * n)
    for row in cells.groupBy("cell").agg(F.sum("value").alias("value")).collect():  # n * n rows
        out[row.cell] = row.value
    return out.reshape(n, n)


def _turned(block: DataFrame, matrix: np.ndarray) -> DataFrame:
    """block times matrix; its other columns stay."""
    names = [f"q{i}" for i in range(matrix.shape[1])]
    other = [(c, t) for c, t in block.dtypes if c not in _numbers(block.columns)]
    keys = [c for c, _ in other]

    def run(batches):
        for batch in batches:
            m = _matrix(batch) @ matrix
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *(pa.array(m[:, i]) for i in range(m.shape[1]))], [*keys, *names])

    return block.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in other), *(f"{n} double" for n in names)]))


def _unit_rows(block: DataFrame) -> DataFrame:
    """film_id and vec: the other columns as an array of unit length; a zero row stays zero."""
    vec = F.array(*block.columns[1:])
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return block.select(F.col("film_id").cast("bigint").alias("film_id"), vec.alias("vec")).withColumn("length", length).select("film_id", F.when(F.col("length") > 1e-12, F.transform("vec", lambda x: x / F.col("length"))).otherwise(F.col("vec")).alias("vec"))
