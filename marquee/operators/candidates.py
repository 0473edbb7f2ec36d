"""Candidate sources judged over seeds: how far each one reaches, how they overlap, and which share of a budget each should have."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.operators import evaluation as E
from marquee.operators import quantiles, ranking, vectors
from marquee.sources.work import saved

SOURCES = ("svd", "popularity")


def seed_pass(logs: DataFrame, items: DataFrame, seed: int, depth: int = 200) -> DataFrame:
    """user_id, film_id, svd_rank, popularity_rank, target, stratum, percentile: the candidates of every user with a test target, and the targets, retrieved or not.

    Popularity is of the contexts of all users; films without positives come last. Ranks count unwatched films of the catalog only.
    """
    split = saved(E.holdout(logs, seed))
    context = split.where("role = 'context'").select("user_id", "film_id", "rating")
    catalog = logs.select("film_id", F.lit(None).cast("double").alias("rating"))
    popular = saved(ranking.with_strata(ranking.popularity(context.select("film_id", "rating").unionByName(catalog))))
    targets = split.where("role = 'test'").select("user_id", "film_id")
    mine = saved(context.join(targets.select("user_id"), "user_id", "left_semi"))
    known = items.join(popular.select("film_id"), "film_id", "left_semi")
    places = ranking.watched_places(mine, popular, depth)
    svd = vectors.top_k_lists(vectors.user_profiles(mine, known), known, depth, mine, along=places.users)
    both = ranking.candidates(svd, places, depth, mode="post_exclusion")
    rows = both.join(targets.withColumn("target", F.lit(True)), ["user_id", "film_id"], "full")
    rows = rows.select("user_id", "film_id", "svd_rank", "popularity_rank", F.coalesce("target", F.lit(False)).alias("target"))
    within = known.select("film_id").unionByName(places.films.select("film_id")).unionByName(targets.select("film_id")).distinct()
    return rows.join(ranking.small(saved(popular.join(within, "film_id", "left_semi").select("film_id", "stratum", "percentile"))), "film_id")


def _by_source(rows: DataFrame) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("source"), F.col(f"{s}_rank").alias("rank")) for s in SOURCES)))
    return rows.select("*", each.alias("s")).select(*(c for c in rows.columns if not c.endswith("_rank")), "s.source", "s.rank")


def views(rows: DataFrame) -> DataFrame:
    """seed, source, view and metrics: over all targets (all), and over those of users for whom the source has candidates (served)."""
    has = rows.groupBy("seed", "user_id").agg(*(F.count(f"{s}_rank").alias(f"{s}_rank") for s in SOURCES))
    served = _by_source(has).where("rank > 0").select("seed", "user_id", "source")
    ranks = _by_source(rows.where("target"))
    keys = ["seed", "source"]
    some = E.metrics(ranks.join(served, ["seed", "user_id", "source"], "left_semi"), keys)
    return E.metrics(ranks, keys).withColumn("view", F.lit("all")).unionByName(some.withColumn("view", F.lit("served")))


def reach(rows: DataFrame, cutoffs: tuple[int, ...] = E.CUTOFFS) -> DataFrame:
    """seed, source, cutoff: share (of the catalog, by percentile's films), mean and median popularity percentile of the films in all lists cut there.

    Lists are counted by film first; only these counts meet the cutoffs, and the median adds them up in ranges.
    """
    listed = _by_source(rows).where("rank IS NOT NULL")
    films = listed.groupBy("seed", "source", "film_id", "percentile").agg(F.array(*(F.struct(F.lit(k).alias("cutoff"), F.count_if(F.col("rank") <= k).alias("n")) for k in cutoffs)).alias("c"))
    keys = ["seed", "source", "cutoff"]
    films = saved(films.select("seed", "source", "percentile", F.explode("c").alias("c")).select("seed", "source", "percentile", "c.*").where("n > 0"))
    p = F.col("percentile").cast("decimal(18,12)")
    sums = films.groupBy(*keys).agg(F.count("*").alias("films"), F.round(F.sum(p * F.col("n")).cast("double") / F.sum("n"), 6).alias("mean_percentile"))
    middle = quantiles.weighted_median(films, keys, "percentile", "n").select(*keys, F.round("median", 6).alias("median_percentile"))
    return sums.join(middle, keys)


def overlap(rows: DataFrame, cutoffs: tuple[int, ...] = E.CUTOFFS) -> DataFrame:
    """seed, cutoff, jaccard: the mean over users of the likeness of their two lists cut there; two empty lists are alike."""
    inside = lambda k: [F.coalesce(F.col(f"{s}_rank") <= k, F.lit(False)) for s in SOURCES]
    one = [F.struct(F.lit(k).alias("cutoff"), F.coalesce(F.try_divide(F.count_if(a & b), F.count_if(a | b)), F.lit(1.0)).alias("j")) for k in cutoffs for a, b in [inside(k)]]
    users = rows.groupBy("seed", "user_id").agg(F.array(*one).alias("c")).select("seed", F.explode("c").alias("c"))
    return users.groupBy("seed", "c.cutoff").agg(F.round(F.avg("c.j"), 6).alias("jaccard"))


def attribution(rows: DataFrame) -> DataFrame:
    """seed, found, share: the targets that both sources hold, one alone, or none (missed)."""
    a, b = (F.col(f"{s}_rank").isNotNull() for s in SOURCES)
    found = {"both": a & b, "svd_only": a & ~b, "popularity_only": ~a & b, "missed": ~a & ~b}
    shares = rows.where("target").groupBy("seed").agg(F.array(*(F.struct(F.lit(n).alias("found"), F.round(F.avg(t.cast("double")), 6).alias("share")) for n, t in found.items())).alias("s"))
    return shares.select("seed", F.explode("s").alias("s")).select("seed", "s.*")


def sweep(rows: DataFrame, budgets: list[int], ratios: list[float]) -> DataFrame:
    """seed, budget, svd_depth, recall, mean_size of every allocation; svd_depth is null for the union of both lists cut at the budget.

    Rows are counted by their two ranks, at most (depth + 1) squared cells a seed, before they meet the grid.
    """
    cells = [(b, round(b * r), round(b * r), b - round(b * r)) for b in budgets for r in ratios] + [(b, None, b, b) for b in budgets]
    grid = F.broadcast(rows.sparkSession.createDataFrame(cells, "budget int, svd_depth int, a int, b int"))
    users = rows.groupBy("seed").agg(F.count_distinct("user_id").alias("users"), F.count_if("target").alias("targets"))
    counted = rows.groupBy("seed", "svd_rank", "popularity_rank").agg(F.count("*").alias("n"), F.count_if("target").alias("t"))
    hit = F.coalesce(F.col("svd_rank") <= F.col("a"), F.lit(False)) | F.coalesce(F.col("popularity_rank") <= F.col("b"), F.lit(False))
    sums = counted.crossJoin(grid).groupBy("seed", "budget", "svd_depth").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(hit, F.col("t")).otherwise(0)).alias("t"))
    out = sums.join(F.broadcast(users), "seed")  # a row a seed
    return out.select("seed", "budget", "svd_depth", F.round(F.col("t") / F.col("targets"), 6).alias("recall"), F.round(F.col("n") / F.col("users"), 6).alias("mean_size"))


def shortlist(runs: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """budget, svd_depth, recall and size over seeds (mean, std), chosen, near, edge.

    chosen: the best mean recall of a budget, then the least deviation, then the most of svd. near: within tolerance of it. edge: the
    least or greatest svd_depth of the grid, where a chosen one leaves the best ratio unresolved.
    """
    over = E.over_runs(runs.where("svd_depth IS NOT NULL"), ["budget", "svd_depth"], ["recall", "mean_size"])
    w = Window.partitionBy("budget")  # a row an allocation
    place = F.row_number().over(w.orderBy(F.desc("recall_mean"), "recall_std", F.desc("svd_depth")))
    edge = (F.col("svd_depth") == F.min("svd_depth").over(w)) | (F.col("svd_depth") == F.max("svd_depth").over(w))
    near = F.round(F.max("recall_mean").over(w) - F.col("recall_mean"), 6) <= tolerance
    return over.withColumns({"chosen": place == 1, "near": near, "edge": edge})


def recommendation(short: DataFrame, least: int, most: int, gain: float = 0.02) -> DataFrame:
    """One row: budget, svd_depth, popularity_depth, recall, measured (the budget's own gain is under gain; else it is the greatest one allowed)."""
    best = short.where("chosen").select("budget", "svd_depth", F.col("recall_mean").alias("recall"))
    steps = E.marginal_value(best)
    picked = E.chosen_budget(steps, least, gain, most).join(best, "budget").join(steps.select("budget", "gain"), "budget")
    return picked.select("budget", "svd_depth", (F.col("budget") - F.col("svd_depth")).alias("popularity_depth"), "recall", F.coalesce((F.col("gain") < gain) & (F.col("budget") >= least), F.lit(False)).alias("measured"))


def report(rows: DataFrame, budgets: list[int], ratios: list[float], least: int, most: int) -> DataFrame:
    """section, name, metric, value over the seeds of rows(seed, ...) as ``seed_pass`` gives them."""
    names = ["recall_10", "recall_20", "recall_50", "ndcg_20", "mrr_10"]
    runs = saved(sweep(rows, budgets, ratios))
    short = saved(shortlist(runs))
    strata = E.metrics(_by_source(rows.where("target")), ["seed", "source", "stratum"])
    union = E.over_runs(runs.where("svd_depth IS NULL"), ["budget"], ["recall", "mean_size"])
    steps = E.marginal_value(short.where("chosen").select("budget", F.col("recall_mean").alias("recall")))

    def over(section: str, df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
        return long(section, E.over_runs(df, by, values), by, [f"{v}_{s}" for v in values for s in ("mean", "std")])

    def long(section: str, df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
        each = F.explode(F.array(*(F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values)))
        name: Column = F.concat_ws("/", *(F.col(c).cast("string") for c in by)) if by else F.lit("")
        return df.select(F.lit(section).alias("section"), name.alias("name"), each.alias("m")).select("section", "name", "m.metric", "m.value")

    parts = [
        over("source", views(rows), ["source", "view"], names),
        over("stratum", strata, ["source", "stratum"], ["targets", "recall_20", "ndcg_20"]),
        over("reach", reach(rows), ["source", "cutoff"], ["films", "mean_percentile", "median_percentile"]),
        over("overlap", overlap(rows), ["cutoff"], ["jaccard"]),
        over("found", attribution(rows), ["found"], ["share"]),
        long("union", union, ["budget"], ["recall_mean", "recall_std", "mean_size_mean"]),
        long("allocation", short, ["budget", "svd_depth"], ["recall_mean", "recall_std", "mean_size_mean", "chosen", "near", "edge"]),
        long("step", steps, ["budget"], ["recall", "gain"]),
        long("recommended", recommendation(short, least, most), [], ["budget", "svd_depth", "popularity_depth", "recall", "measured"]),
    ]
    return reduce(DataFrame.unionByName, parts)


def document(rows: DataFrame) -> DataFrame:
    """A report's rows nested, a row a section: section, entries (name to metric to value). A report has as many rows as its grid, whatever its input."""
    values = F.array_sort(F.collect_list(F.struct("metric", "value")))
    entries = rows.groupBy("section", "name").agg(values.alias("values")).groupBy("section").agg(F.array_sort(F.collect_list(F.struct("name", "values"))).alias("e"))
    return entries.select("section", F.transform_values(F.map_from_entries("e"), lambda _, v: F.map_from_entries(v)).alias("entries"))
