"""Leakage-safe evaluation: splits, folds, samples, metrics, grids, bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import ratings as R
from marquee.operators.preferences import entity_ratings
from marquee.operators.quality import ranged
from marquee.operators.ranking import Places, popular_lists, small
from marquee.sources.work import saved

CUTOFFS = (10, 20, 50)


def order_key(seed: int, *columns: str) -> Column:
    """A reproducible random order: other users' rows never change it."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)).cast("binary"))


#: Rows that a task sorts, about.
HELD = 1 << 21


def tasks_for(rows: DataFrame) -> int:
    """Tasks for the rows of a stored table: one for each HELD rows and at least one for each core. Sizes after compression, by which Spark joins tasks, tell little of the memory that a sort takes."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // HELD))


def holdout(logs: DataFrame, seed: int = 42, tasks: int | None = None) -> DataFrame:
    """logs with role: of users with three positives or more, one is validation, one test; the other rated rows are context.

    tasks is how many users are dealt to; see ``tasks_for``.
    """
    rated = logs.where("rating IS NOT NULL")
    rated = rated if tasks is None else rated.repartition(tasks, "user_id")
    positive = F.col("rating") >= R.POSITIVE
    place = F.row_number().over(Window.partitionBy("user_id", positive).orderBy(order_key(seed, "user_id", "film_id")))
    enough = F.count_if(positive).over(Window.partitionBy("user_id")) >= 3
    rows = rated.withColumn("__e", enough).withColumn("__p", place)  # users first: the finer window then needs no shuffle of its own
    role = F.when(positive & F.col("__e") & (F.col("__p") == 1), "validation").when(positive & F.col("__e") & (F.col("__p") == 2), "test").otherwise("context")
    return rows.withColumn("role", role).drop("__p", "__e")


def folds(split: DataFrame, strata: DataFrame, seed: int = 42, n: int = 5) -> DataFrame:
    """user_id, depth, stratum, fold of users with a test target: balanced within history depth quartile and target stratum."""
    context = split.where("role = 'context'").groupBy("user_id").agg(F.count("*").alias("size"))
    users = split.where("role = 'test'").select("user_id", "film_id").join(context, "user_id", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    cuts = users.agg(*(F.percentile("size", F.lit(q)).alias(f"q{i}") for i, q in enumerate((0.25, 0.5, 0.75))))
    rows = users.crossJoin(F.broadcast(cuts)).join(strata.select("film_id", "stratum"), "film_id")
    rows = rows.withColumn("depth", R.quantile_bucket(F.col("size"), [F.col(f"q{i}") for i in range(3)]))
    # There are twelve groups at most, so places come from one order of all rows less each group's first number.
    rows = ranged(rows.select("user_id", "depth", "stratum", order_key(seed, "user_id").alias("h")), ["depth", "stratum", "h"], "number")
    first = rows.groupBy("depth", "stratum").agg(F.min("number").alias("first"))
    rows = rows.join(F.broadcast(first), ["depth", "stratum"])
    offset = F.when(F.col("stratum") == "HEAD", 0).when(F.col("stratum") == "MID", 1).otherwise(2) + F.col("depth")
    return rows.select("user_id", "depth", "stratum", F.pmod(F.col("number") - F.col("first") + 1 + offset, F.lit(n)).cast("int").alias("fold"))


def partitions(fold_rows: DataFrame, fold: int, n: int = 5) -> DataFrame:
    """user_id, partition: the fold is test, the next one validation, the rest train."""
    return fold_rows.select("user_id", F.when(F.col("fold") == fold, "test").when(F.col("fold") == (fold + 1) % n, "validation").otherwise("train").alias("partition"))


def training_holdouts(split: DataFrame, seed: int = 42, most: int = 8) -> DataFrame:
    """Up to most context positives of each user, in turn over labels 1, 2, 3."""
    rows = split.where((F.col("role") == "context") & (F.col("rating") >= R.POSITIVE)).repartition("user_id").withColumn("label", R.relevance(F.col("rating")))  # users first, as in holdout
    turn = F.row_number().over(Window.partitionBy("user_id", "label").orderBy(order_key(seed, "user_id", "film_id")))
    rows = rows.withColumn("turn", turn)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("turn", "label"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("user_id", "film_id", "label", "place")


#: Candidates for each label, about.
GROUP = 200
# Fixed quotas of the negative sampler, in order: name, share of the negatives.
QUOTAS = (("both", 0.25), ("svd_only", 0.25), ("popularity_only", 0.20), ("top", 0.125), ("middle", 0.10))


def sampled_groups(candidates: DataFrame, labels: DataFrame, cap: int = 512, seed: int = 42) -> DataFrame:
    """user_id, film_id, label, taken_by: every positive candidate, then negatives by quota up to cap rows a user.

    candidates has membership and popularity_rank. Each quota takes from what earlier ones left, by hash order; the rest is
    filled in hash order. Only window functions; a user's candidates are bounded by the source depths.
    """
    # Candidates and labels are shuffled by user once, without their hashes; labels are found within a user's rows.
    own = candidates.select("user_id", "film_id", F.lit(None).cast(labels.schema["label"].dataType).alias("label"), "membership", "popularity_rank", F.lit(True).alias("open"))
    given = labels.select("user_id", "film_id", "label", F.lit(False).alias("open"))
    tasks = max(int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")), labels.count() * GROUP // HELD)
    rows = own.unionByName(given, allowMissingColumns=True).repartition(tasks, "user_id")
    rows = rows.withColumn("label", F.max("label").over(Window.partitionBy("user_id", "film_id"))).where("open").withColumn("h", F.unhex(order_key(seed, "user_id", "film_id")))
    positive = F.coalesce(F.col("label"), F.lit(0)) > 0
    rows = rows.withColumn("taken_by", F.when(positive, "positive")).withColumn("room", F.lit(cap) - F.count_if(positive).over(Window.partitionBy("user_id")))
    tests = {"both": F.col("membership") == "both", "svd_only": F.col("membership") == "svd_only", "popularity_only": F.col("membership") == "popularity_only", "top": F.col("popularity_rank") <= 500, "middle": F.col("popularity_rank").between(501, 2000)}
    for name, share in QUOTAS:
        free = F.col("taken_by").isNull() & F.coalesce(tests[name], F.lit(False))
        place = F.row_number().over(Window.partitionBy("user_id", free).orderBy("h"))
        rows = rows.withColumn("__p", place).withColumn("taken_by", F.when(free & (F.col("__p") <= F.floor(F.col("room") * share)), name).otherwise(F.col("taken_by")))
    have = F.count("taken_by").over(Window.partitionBy("user_id"))
    free = F.col("taken_by").isNull()
    place = F.row_number().over(Window.partitionBy("user_id", free).orderBy("h"))
    rows = rows.withColumn("__p", place).withColumn("__have", have)
    rows = rows.withColumn("taken_by", F.when(free & (F.col("__p") <= cap - F.col("__have")), "fill").otherwise(F.col("taken_by")))
    return rows.where("taken_by IS NOT NULL").select("user_id", "film_id", F.coalesce("label", F.lit(0)).alias("label"), "taken_by")


def full_groups(candidates: DataFrame, forbidden: DataFrame, labels: DataFrame) -> DataFrame:
    """Every candidate that isn't forbidden, with its label or 0."""
    rows = candidates.join(forbidden.select("user_id", "film_id"), ["user_id", "film_id"], "left_anti")
    return rows.join(labels.select("user_id", "film_id", "label"), ["user_id", "film_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def target_ranks(scores: DataFrame, targets: DataFrame, pessimistic: bool = False) -> DataFrame:
    """user_id, film_id, rank of each target among its user's scores, ties by film_id (or against the target); null if it has no score."""
    s = F.when(F.isnan("score") | F.col("score").isNull(), float("-inf")).otherwise(F.col("score"))
    rows = scores.select("user_id", F.col("film_id").alias("other"), s.alias("s"))
    own = targets.join(scores.select("user_id", "film_id", s.alias("t")), ["user_id", "film_id"], "left")
    joined = own.join(rows, "user_id", "left")
    tie = (F.col("s") == F.col("t")) & ((F.col("other") != F.col("film_id")) if pessimistic else (F.col("other") < F.col("film_id")))
    better = F.count_if((F.col("s") > F.col("t")) | tie)
    return joined.groupBy("user_id", "film_id").agg(F.when(F.max("t").isNotNull(), better + 1).alias("rank"))


def metrics(ranks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """targets, recall@k, ndcg@k and mrr@10 of ranks(rank, ...); a null rank is a miss that counts."""
    r = F.col("rank")
    columns = [F.count("*").alias("targets")]
    columns += [F.round(F.avg(F.when(r <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in CUTOFFS]
    columns += [F.round(F.avg(F.when(r <= k, 1 / F.log2(r + 1.0)).otherwise(0.0)), 6).alias(f"ndcg_{k}") for k in CUTOFFS[:2]]
    columns += [F.round(F.avg(F.when(r <= 10, 1.0 / r).otherwise(0.0)), 6).alias("mrr_10")]
    return ranks.groupBy(*(by or [])).agg(*columns)


def views(ranks: DataFrame) -> DataFrame:
    """metrics over all targets (global) and over those retrieved (conditional), with candidate_recall."""
    recall = ranks.agg(F.round(F.avg(F.col("rank").isNotNull().cast("double")), 6).alias("candidate_recall"))
    both = metrics(ranks).withColumn("view", F.lit("global")).unionByName(metrics(ranks.where("rank IS NOT NULL")).withColumn("view", F.lit("conditional")))
    return both.crossJoin(F.broadcast(recall))


def segments(ranks: DataFrame, columns: list[str]) -> DataFrame:
    """metrics by each column in turn, as (segment, value, ...)."""
    out = None
    for c in columns:
        part = metrics(ranks, [c]).withColumnRenamed(c, "value").withColumn("segment", F.lit(c)).withColumn("value", F.col("value").cast("string"))
        out = part if out is None else out.unionByName(part)
    return out


def graded_ndcg(scores: DataFrame, k: int) -> DataFrame:
    """user_id, ndcg of scores(user_id, film_id, score, label) with gains 0, 1, 3, 7; 0 without any gain."""
    by_score = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("score").desc(), "film_id"))
    by_gain = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("g").desc(), "film_id"))
    rows = scores.withColumn("g", R.gain(F.col("label")).cast("double")).withColumn("a", by_score).withColumn("b", by_gain)
    got, best = (F.sum(F.when(F.col(c) <= k, F.col("g") / F.log2(F.col(c) + 1.0)).otherwise(0.0)) for c in "ab")
    return rows.groupBy("user_id").agg(F.round(F.when(best > 0, got / best).otherwise(0.0), 6).alias("ndcg"))


def over_runs(reports: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Mean and population deviation of metrics over folds and seeds."""
    return reports.groupBy(*by).agg(*(f.alias(a) for n in names for f, a in ((F.round(F.avg(n), 6), f"{n}_mean"), (F.round(F.stddev_pop(n), 6), f"{n}_std"))))


def coverage(ranked: DataFrame, catalog_size: int, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """cutoff, films, share: distinct films within each cutoff of any user's list."""
    at = F.array(*(F.when(F.col("rank") <= k, k) for k in cutoffs))
    rows = ranked.select("film_id", F.explode(at).alias("cutoff")).where("cutoff IS NOT NULL")
    return rows.groupBy("cutoff").agg(F.count_distinct("film_id").alias("films")).withColumn("share", F.round(F.col("films") / catalog_size, 6))


def retrieved_popularity(ranked: DataFrame, strata: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """cutoff, mean and median popularity percentile of the retrieved films."""
    at = F.array(*(F.when(F.col("rank") <= k, k) for k in cutoffs))
    # Films are counted before they meet their percentiles.
    films = ranked.select("film_id", F.explode(at).alias("cutoff")).where("cutoff IS NOT NULL").groupBy("film_id", "cutoff").agg(F.count("*").alias("n"))
    p, n = F.col("percentile"), F.col("n")
    rows = films.join(strata.select("film_id", "percentile"), "film_id").groupBy("cutoff")
    return rows.agg(F.round(F.sum(p * n) / F.sum(n), 6).alias("mean_percentile"), F.round(F.percentile(p, F.lit(0.5), n), 6).alias("median_percentile"))


def mean_jaccard(a: DataFrame, b: DataFrame, users: DataFrame) -> DataFrame:
    """One row: the mean over users of the Jaccard similarity of two film lists; two empty lists are alike."""
    both = a.select("user_id", "film_id", F.lit(1).alias("x")).join(b.select("user_id", "film_id", F.lit(1).alias("y")), ["user_id", "film_id"], "full")
    sizes = both.groupBy("user_id").agg((F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()) / F.count("*")).alias("j"))
    return users.select("user_id").join(sizes, "user_id", "left").agg(F.round(F.avg(F.coalesce("j", F.lit(1.0))), 6).alias("jaccard"))


def hit_attribution(targets: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Number and share of targets by which sources(user_id, film_id) hold them."""
    rows = targets
    for name, s in sources.items():
        rows = rows.join(s.select("user_id", "film_id", F.lit(True).alias(name)), ["user_id", "film_id"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    total = Window.partitionBy()
    return rows.groupBy(*sources).agg(F.count("*").alias("targets")).withColumn("share", F.round(F.col("targets") / F.sum("targets").over(total), 6))


def allocation_sweep(ranks: DataFrame, budgets: list[int], ratios: list[float]) -> DataFrame:
    """budget, ratio, recall: of targets(svd_rank, popularity_rank; null if not retrieved), the share within the depths that a ratio gives each source."""
    grid = ranks.sparkSession.createDataFrame([(b, r, round(b * r), b - round(b * r)) for b in budgets for r in ratios], "budget int, ratio double, svd_depth int, popularity_depth int")
    hit = (F.col("svd_rank") <= F.col("svd_depth")) | (F.col("popularity_rank") <= F.col("popularity_depth"))
    return ranks.crossJoin(F.broadcast(grid)).groupBy("budget", "ratio").agg(F.round(F.avg(F.coalesce(hit, F.lit(False)).cast("double")), 6).alias("recall"))


def allocation_report(targets: DataFrame, candidates: DataFrame, strata: DataFrame, budgets: list[int], ratios: list[float]) -> DataFrame:
    """budget, ratio, recall (all targets and each stratum), films a user, catalog films and mean popularity percentile of every allocation.

    targets(stratum, svd_rank, popularity_rank), candidates(user_id, film_id, svd_rank, popularity_rank). Rows are first counted by
    their two ranks, at most (depth + 1) squared cells, and films reduced to their best ranks; only these meet the grid.
    """
    cells = [(b, r, round(b * r), b - round(b * r)) for b in budgets for r in ratios]
    grid = F.broadcast(targets.sparkSession.createDataFrame(cells, "budget int, ratio double, svd_depth int, popularity_depth int"))
    hit = F.coalesce(F.col("svd_rank") <= F.col("svd_depth"), F.lit(False)) | F.coalesce(F.col("popularity_rank") <= F.col("popularity_depth"), F.lit(False))
    keys, ranks = ["budget", "ratio"], ["svd_rank", "popularity_rank"]

    def share(test: Column) -> Column:
        return F.round(F.try_divide(F.sum(F.when(test & hit, F.col("n")).otherwise(0)), F.sum(F.when(test, F.col("n")).otherwise(0))), 6)

    found = targets.groupBy("stratum", *ranks).agg(F.count("*").alias("n")).crossJoin(grid).groupBy(*keys)
    recall = found.agg(share(F.lit(True)).alias("recall"), *(share(F.col("stratum") == s).alias(f"recall_{s.lower()}") for s in ("HEAD", "MID", "TAIL")))
    users = candidates.agg(F.count_distinct("user_id").alias("users"))
    rows = candidates.join(strata.select("film_id", F.col("percentile").cast("decimal(18,12)").alias("percentile")), "film_id")
    counted = rows.groupBy(*ranks).agg(F.count("*").alias("n"), F.sum("percentile").alias("p")).crossJoin(grid).where(hit)
    sizes = counted.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("p").alias("p")).crossJoin(F.broadcast(users))
    sizes = sizes.select(*keys, F.round(F.col("n") / F.col("users"), 6).alias("mean_size"), F.round(F.col("p").cast("double") / F.col("n"), 6).alias("mean_percentile"))
    best = rows.groupBy("film_id").agg(*(F.min(c).alias(c) for c in ranks)).crossJoin(grid).where(hit).groupBy(*keys).agg(F.count("*").alias("films"))
    return recall.join(sizes, keys, "left").join(best, keys, "left")


def recommended_sources(sweep: DataFrame, budget: DataFrame) -> DataFrame:
    """One row: the chosen budget with its best ratio (the least of equal ones), depths and expected recall."""
    rows = sweep.join(F.broadcast(budget), "budget")
    best = F.max_by(F.struct("ratio", "recall"), F.struct("recall", -F.col("ratio")))
    picked = rows.groupBy("budget").agg(best.alias("b")).select("budget", "b.ratio", "b.recall")
    depth = F.round(F.col("budget") * F.col("ratio")).cast("bigint")
    return picked.select("budget", "ratio", depth.alias("svd_depth"), (F.col("budget") - depth).alias("popularity_depth"), "recall")


def near_winners(sweep: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Each budget's configurations within tolerance of its best recall; edge tells the least and greatest ratio."""
    w = Window.partitionBy("budget")
    rows = sweep.withColumn("best", F.max("recall").over(w)).withColumn("edge", (F.col("ratio") == F.min("ratio").over(w)) | (F.col("ratio") == F.max("ratio").over(w)))
    return rows.where(F.col("recall") >= F.col("best") - tolerance).select("budget", "ratio", "recall", "edge")


def marginal_value(sweep: DataFrame) -> DataFrame:
    """budget, recall, gain over the budget before."""
    best = sweep.groupBy("budget").agg(F.max("recall").alias("recall"))
    return best.withColumn("gain", F.round(F.col("recall") - F.lag("recall").over(Window.orderBy("budget")), 6))


def chosen_budget(marginal: DataFrame, least: int = 1000, gain: float = 0.02, most: int = 4000) -> DataFrame:
    """One row: the first budget from least on that gains under gain, or else the greatest up to most."""
    first = F.min(F.when((F.col("budget") >= least) & (F.col("gain") < gain), F.col("budget")))
    return marginal.agg(F.coalesce(first, F.max(F.when(F.col("budget") <= most, F.col("budget")))).alias("budget"))


#: Users that a task of the bootstrap draws from at a time.
BLOCK = 1024


def _draws(seed: int, replicates: int, users: int, block: int) -> np.ndarray:
    """How many of each replicate's draws fall to a block of users.

    All draws are split in two halves of the blocks again and again; a split's generator is seeded by its range, so that every block
    finds its own numbers and those of all blocks add up to users.
    """
    low, high = 0, -(-users // BLOCK)
    totals = np.full(replicates, users)
    while high - low > 1:
        middle = (low + high) // 2
        share = (middle - low) * BLOCK / (min(high * BLOCK, users) - low * BLOCK)
        left = np.random.default_rng([seed, 0, low, high]).binomial(totals, share)
        if block < middle:
            high, totals = middle, left
        else:
            low, totals = middle, totals - left
    return totals


def bootstrap(deltas: DataFrame, replicates: int = 5000, seed: int = 42) -> DataFrame:
    """One row: users, mean, low and high (95 %) of deltas(user_id, delta), a row a user, resampling users with replacement.

    Every replicate draws as many users as there are, each equally likely. Users are numbered in order and cut into blocks; a block
    draws its own share of all replicates, so that no task holds more than a block. Null deltas take no part; without any, ends are null.
    The result depends on users, deltas and the seed only, not on partitions.
    """
    rows = ranged(deltas.select("user_id", F.col("delta").cast("double").alias("delta")).where("delta IS NOT NULL"), ["user_id"], "number")
    users = rows.count()

    def run(key, group):
        block, values = int(key[0]), group.sort_values("number")["delta"].to_numpy()
        draws, rng = _draws(seed, replicates, users, block), np.random.default_rng([seed, 1, block])
        sums = np.array([values[rng.integers(0, len(values), n)].sum() for n in draws])
        return pd.DataFrame({"replicate": np.arange(replicates, dtype=np.int32), "s": sums})

    sums = rows.withColumn("block", F.expr(f"(number - 1) div {BLOCK}")).groupBy("block").applyInPandas(run, "replicate int, s double")
    means = sums.groupBy("replicate").agg((F.sum("s") / F.lit(float(users or 1))).alias("m"))
    ends = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return rows.agg(F.count("*").alias("users"), F.avg("delta").alias("mean")).crossJoin(ends)


def correlation(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Pearson's correlation, null with fewer than two rows or no spread."""
    flat = (F.stddev_pop(a) < 1e-12) | (F.stddev_pop(b) < 1e-12)
    return rows.agg(F.round(F.when((F.count("*") >= 2) & ~flat, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))), 6).alias("correlation"))


def movers(before: DataFrame, after: DataFrame, k: int = 10) -> DataFrame:
    """The k most improved and the k most worsened targets: direction, user_id, film_id, change."""
    rows = before.select("user_id", "film_id", F.col("rank").alias("a")).join(after.select("user_id", "film_id", F.col("rank").alias("b")), ["user_id", "film_id"]).where("a IS NOT NULL AND b IS NOT NULL").withColumn("change", F.col("b") - F.col("a"))
    up = rows.orderBy("change", "user_id", "film_id").limit(k).withColumn("direction", F.lit("improved"))
    return up.unionByName(rows.orderBy(F.col("change").desc(), "user_id", "film_id").limit(k).withColumn("direction", F.lit("worsened"))).select("direction", "user_id", "film_id", "change")


def film_aggregates(logs: DataFrame, prior: float = 20.0) -> DataFrame:
    """A row per film: count, mean, variance, positive and negative counts and the mean drawn towards the global one."""
    rated = logs.where("rating IS NOT NULL")
    mu = rated.agg(F.avg("rating").alias("mu"))
    own = rated.groupBy("film_id").agg(F.count("*").alias("n"), F.sum("rating").alias("s"), F.sum(F.col("rating") * F.col("rating")).alias("q"), F.count_if(F.col("rating") >= R.POSITIVE).alias("positive"), F.count_if(F.col("rating") <= R.NEGATIVE).alias("negative"))
    mean = F.col("s") / F.col("n")
    return own.crossJoin(F.broadcast(mu)).select("film_id", "n", F.round(mean, 6).alias("mean"), F.round(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)), 6).alias("variance"), "positive", "negative", F.round((F.col("s") + prior * F.col("mu")) / (F.col("n") + prior), 6).alias("smoothed"))


def user_features(logs: DataFrame) -> DataFrame:
    """A row per user of history features over rated films."""
    r = F.col("rating")
    n = F.count("*")
    return logs.where("rating IS NOT NULL").groupBy("user_id").agg(
        n.alias("rated"), F.round(F.log1p(n.cast("double")), 6).alias("log_rated"), F.round(F.avg(r), 6).alias("mean"), F.round(F.var_pop(r), 6).alias("variance"), F.round(F.stddev_pop(r), 6).alias("deviation"),
        F.round(F.avg((r >= R.POSITIVE).cast("double")), 6).alias("positive_fraction"), F.round(F.avg((r <= R.NEGATIVE).cast("double")), 6).alias("negative_fraction"), F.round(F.avg((r >= R.HIGH).cast("double")), 6).alias("high_fraction"), (F.max(r) - F.min(r)).alias("range"),
    )


def ranker_affinity(logs: DataFrame, film_entity: DataFrame, smoothing: float = 5.0) -> DataFrame:
    """user_id, family, entity_id, affinity, support: summed distance from 3 over support plus smoothing."""
    rows = entity_ratings(logs.where("rating IS NOT NULL"), film_entity.select("film_id", "family", "entity_id", F.lit(None).cast("string").alias("name")))
    return rows.groupBy("user_id", "family", "entity_id").agg(F.round(F.sum(F.col("rating") - 3.0) / (F.count("*") + smoothing), 6).alias("affinity"), F.count("*").alias("support"))


def candidate_affinity(candidates: DataFrame, film_entity: DataFrame, affinity: DataFrame) -> DataFrame:
    """A row per (user, film, family): affinity mean (an exact sum, so that row order doesn't matter), max, min, support, matched entities and their share."""
    rows = candidates.select("user_id", "film_id").join(film_entity.select("film_id", "family", "entity_id"), "film_id").join(affinity, ["user_id", "family", "entity_id"], "left")
    a = F.coalesce("affinity", F.lit(0.0))
    return rows.groupBy("user_id", "film_id", "family").agg(F.round(F.sum(a.cast("decimal(18,6)")).cast("double") / F.count("*"), 9).alias("mean"), F.max(a).alias("best"), F.min(a).alias("worst"), F.coalesce(F.sum("support"), F.lit(0)).alias("support"), F.count("affinity").alias("matched"), F.round(F.count("affinity") / F.count("*"), 6).alias("matched_fraction"))


#: Users whose affinities are put together at a time.
USERS = 256


def popular_affinity(places: Places, depth: int, film_entity: DataFrame, affinity: DataFrame) -> DataFrame:
    """``candidate_affinity`` of every user's first depth unwatched films in popularity order.

    A user's films and affinities meet in the user's row, so that neither candidates nor their entities are shuffled as rows.
    Where users reach very many places, films are joined as rows.
    """
    if not places.few:
        rows = popular_lists(places, depth).select("user_id", F.explode("popular").alias("film_id"))
        return candidate_affinity(rows, film_entity, affinity)
    entity = saved(places.films.join(film_entity.select("film_id", "family", "entity_id"), "film_id"))
    numbers = lambda c, out: entity.select(*c).distinct().select(*c, (F.row_number().over(Window.orderBy(*c)) - 1).cast("bigint").alias(out))
    families = F.broadcast(saved(numbers(["family"], "f")))  # a row a family
    count = families.count()
    # A number tells an entity and, by its remainder, its family. Only entities of films within reach have one.
    codes = small(saved(numbers(["family", "entity_id"], "e").join(families, "family").select("family", "entity_id", (F.col("e") * max(count, 1) + F.col("f")).alias("code"))))
    by_family = F.transform(F.array_sort(F.collect_list(F.struct((F.col("code") % max(count, 1)).alias("f"), "code"))), lambda x: x["code"])
    listed = entity.join(codes, ["family", "entity_id"]).groupBy("popularity_rank").agg(by_family.alias("codes"))
    ordered = places.films.join(listed, "popularity_rank", "left").agg(F.array_sort(F.collect_list(F.struct("popularity_rank", "codes"))).alias("__codes"))  # one row
    own = affinity.join(codes, ["family", "entity_id"]).groupBy("user_id").agg(F.collect_list(F.struct("code", "affinity", "support")).alias("a"))
    rows = popular_lists(places, depth).join(own, "user_id", "left").crossJoin(F.broadcast(ordered))
    none = F.array().cast("array<bigint>")
    rows = rows.select(
        F.col("user_id").cast("bigint").alias("user_id"), F.coalesce("popular", none).alias("film"), F.coalesce(F.transform("place", lambda p: F.coalesce(F.get("__codes", (p - 1).cast("int"))["codes"], none)), F.array().cast("array<array<bigint>>")).alias("codes"),
        *(F.coalesce(F.col(f"a.{c}").cast(f"array<{t}>"), F.array().cast(f"array<{t}>")).alias(c) for c, t in (("code", "bigint"), ("affinity", "double"), ("support", "bigint"))),
    )

    def put(users: pa.RecordBatch) -> pa.RecordBatch:
        def flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
            return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten()

        (user, film), (_, inner), (owner, own) = (flat(users.column(c)) for c in ("film", "codes", "code"))
        at, code = flat(inner)  # of each film's entities: the film's place in the batch
        code, own = code.to_numpy(zero_copy_only=False), own.to_numpy(zero_copy_only=False)
        known, number = np.unique(np.concatenate([code, own]), return_inverse=True)
        wide = max(len(known), 1)
        have, want = owner * wide + number[len(code) :], user[at] * wide + number[: len(code)]
        order = np.argsort(have)
        have = have[order]
        affinities, support = (users.column(c).flatten().to_numpy(zero_copy_only=False)[order] for c in ("affinity", "support"))
        found = np.minimum(np.searchsorted(have, want), max(len(have) - 1, 0))
        hit = have[found] == want if len(have) else np.zeros(len(want), bool)
        a, n = np.zeros(len(want)), np.zeros(len(want), np.int64)
        a[hit], n[hit] = affinities[found[hit]], support[found[hit]]
        group = at * max(count, 1) + code % max(count, 1)  # ascending, as codes are listed by family
        first = np.flatnonzero(np.diff(group, prepend=-1))
        total = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0, x.dtype)
        ends = [f.reduceat(a, first) if len(first) else np.zeros(0) for f in (np.maximum, np.minimum)]
        film_at = at[first]
        columns = [users.column("user_id").take(pa.array(user[film_at])), film.take(pa.array(film_at)), *(pa.array(c) for c in (group[first] % max(count, 1), total(np.rint(a * 1e6).astype(np.int64)), total(np.ones(len(a), np.int64)), *ends, total(n), total(hit.astype(np.int64))))]
        return pa.RecordBatch.from_arrays(columns, ["user_id", "film_id", "f", "s", "n", "best", "worst", "support", "matched"])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, USERS):
                yield put(batch.slice(start, USERS))

    out = rows.mapInArrow(run, "user_id bigint, film_id bigint, f bigint, s bigint, n bigint, best double, worst double, support bigint, matched bigint").join(families, "f")
    return out.select("user_id", "film_id", "family", F.round(F.col("s") / F.lit(1e6) / F.col("n"), 9).alias("mean"), "best", "worst", "support", "matched", F.round(F.col("matched") / F.col("n"), 6).alias("matched_fraction"))


def weighted_preferences(logs: DataFrame, films: DataFrame, column: str) -> DataFrame:
    """user_id, mean, deviation of a film column weighted by max(rating - 3, 0); users without weight have none."""
    return each_weighted(logs, films, [column])[column]


def each_weighted(logs: DataFrame, films: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """``weighted_preferences`` of several columns, from one join with the films, written once."""
    rows = logs.where("rating > 3").join(films.select("film_id", *(F.col(c).cast("double").alias(c) for c in columns)), "film_id").withColumn("w", F.col("rating") - 3.0)
    sums = [s.alias(f"{n}_{c}") for c in columns for w in [F.when(F.col(c).isNotNull(), F.col("w"))] for n, s in (("w", F.sum(w)), ("wx", F.sum(w * F.col(c))), ("wxx", F.sum(w * F.col(c) * F.col(c))))]
    table = rows.groupBy("user_id").agg(*sums)
    table = saved(table) if len(columns) > 1 else table

    def one(c: str) -> DataFrame:
        w, wx, wxx = (F.col(f"{n}_{c}") for n in ("w", "wx", "wxx"))
        mean = wx / w
        return table.where(w.isNotNull()).select("user_id", F.round(mean, 4).alias("mean"), F.round(F.sqrt(F.greatest(wxx / w - mean * mean, F.lit(0.0))), 4).alias("deviation"))

    return {c: one(c) for c in columns}


def dataset_audit(rows: DataFrame, features: list[str]) -> DataFrame:
    """name, value: rows, groups, label shares and each feature's missing rate."""
    return dataset_audits(rows, [], features)


def dataset_audits(rows: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """dataset_audit() of each part of rows by columns."""
    out = rows.groupBy(*by).agg(F.count("*").cast("double").alias("rows_"), F.count_distinct("user_id").cast("double").alias("groups"), *(F.round(F.avg((F.col("label") == k).cast("double")), 6).alias(f"label_{k}") for k in range(4)), *(F.round(F.avg(F.col(c).isNull().cast("double")), 6).alias(f"missing_{c}") for c in features))
    return out.unpivot(by, [c for c in out.columns if c not in by], "name", "value")


def retraining_decision(logs: DataFrame, trained_films: DataFrame, trained: DataFrame, forced: bool = False, users: int = 100, films: int = 250, days: int = 180) -> DataFrame:
    """One row: user_delta, interaction_delta, new_films, age_days, reasons. trained has one row (users, interactions, age_days) or none; counts under 0 are unknown."""
    rated = logs.where("rating IS NOT NULL")
    now = rated.agg(F.count_distinct("user_id").alias("u"), F.count("*").alias("i"))
    new = rated.select("film_id").distinct().join(trained_films.select("film_id"), "film_id", "left_anti").agg(F.count("*").alias("new_films"))
    base = trained.select(F.col("users").alias("bu"), F.col("interactions").alias("bi"), F.col("age_days").alias("age"), F.lit(True).alias("model"))
    rows = now.crossJoin(new).join(base, F.lit(True), "left")  # one row each
    unknown = (F.col("bu") < 0) | (F.col("bi") < 0)
    user_delta = F.when(F.col("model").isNull(), F.col("u")).when(F.col("bu") < 0, 0).otherwise(F.greatest(F.lit(0), F.col("u") - F.col("bu")))
    interaction_delta = F.when(F.col("model").isNull(), F.col("i")).when(F.col("bi") < 0, 0).otherwise(F.col("i") - F.col("bi"))
    rows = rows.select(user_delta.cast("bigint").alias("user_delta"), interaction_delta.cast("bigint").alias("interaction_delta"), "new_films", F.coalesce("age", F.lit(0.0)).alias("age_days"), F.coalesce(unknown, F.lit(False)).alias("unknown"), F.col("model").isNotNull().alias("model"))
    return retraining_reasons(rows, forced, users, films, days)


def retraining_reasons(rows: DataFrame, forced: bool = False, users: int = 100, films: int = 250, days: int = 180) -> DataFrame:
    """user_delta, interaction_delta, new_films, age_days, reasons of rows with these deltas, unknown (the model's counts) and model (there is one)."""
    known = ~F.col("unknown")
    tests = [("forced", F.lit(forced)), ("bootstrap", F.col("unknown")), ("users", known & (F.col("user_delta") >= users)), ("films", known & (F.col("new_films") >= films)), ("age", known & F.col("model") & (F.col("age_days") >= days))]
    return rows.select("user_delta", "interaction_delta", "new_films", "age_days", F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in tests)), lambda x: x.isNotNull()).alias("reasons"))
