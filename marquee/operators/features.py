"""Ranking features, grids and reports over candidates and shelves; inputs are never collected."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.operators.evaluation import metrics
from marquee.operators.ranking import Places, _rounded, popular_lists, within_reach
from marquee.operators.vectors import dot

#: Rank of a source that doesn't hold a film.
NO_RANK = 1_000_000_000
# Fixed grid of the fusion's calibration: weights of the vector source, k.
WEIGHTS, KS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8), (20, 60, 100, 200)


def source_features(candidates: DataFrame, depth: int) -> DataFrame:
    """Rank transforms of both sources of each candidate; a missing source gives nulls, the least rank uses ``NO_RANK``."""
    a, b = F.col("svd_rank"), F.col("popularity_rank")
    least = F.least(F.coalesce(a, F.lit(NO_RANK)), F.coalesce(b, F.lit(NO_RANK)))
    columns = [f.alias(f"{n}_{t}") for n, c in (("svd", a), ("popularity", b)) for t, f in (("reciprocal", F.round(1.0 / c, 6)), ("fraction", F.round(c / F.lit(float(depth)), 6)), ("log", F.round(F.log1p(c.cast("double")), 6)))]
    return candidates.select("user_id", "film_id", least.cast("bigint").alias("least_rank"), *columns, F.abs(a - b).alias("rank_gap"))


def catalog_features(films: DataFrame, film_entity: DataFrame, families: list[str], year: int = 2026) -> DataFrame:
    """A row per film: year, decade, age, runtime, their missing flags and the number of entities of each family."""
    counts = film_entity.groupBy("film_id").agg(*(F.count_if(F.col("family") == f).alias(f"n_{f}") for f in families))
    y, r = F.col("year"), F.col("runtime")
    return films.join(counts, "film_id", "left").select(
        "film_id", "year", (F.floor(y / 10) * 10).cast("bigint").alias("decade"), (year - y).alias("age"), "runtime", F.round(F.log1p(r.cast("double")), 6).alias("log_runtime"),
        y.isNull().cast("int").alias("year_missing"), r.isNull().cast("int").alias("runtime_missing"), *(F.coalesce(f"n_{f}", F.lit(0)).cast("bigint").alias(f"n_{f}") for f in families),
    )


def stratum_fractions(positives: DataFrame, strata: DataFrame) -> DataFrame:
    """user_id and the shares of positives in HEAD, MID and TAIL."""
    rows = positives.join(strata.select("film_id", "stratum"), "film_id")
    return rows.groupBy("user_id").agg(*(F.round(F.avg((F.col("stratum") == s).cast("double")), 6).alias(s.lower()) for s in ("HEAD", "MID", "TAIL")))


def _distance(name: str) -> list[Column]:
    """A film's column from <name>_mean, plain and over <name>_dev."""
    d = F.abs(F.col(name) - F.col(f"{name}_mean"))
    return [F.round(d, 4).alias(f"{name}_distance"), F.round(d / F.greatest(F.col(f"{name}_dev"), F.lit(1.0)), 4).alias(f"{name}_z")]


def distance_features(candidates: DataFrame, films: DataFrame, preferences: dict[str, DataFrame]) -> DataFrame:
    """Distance of each candidate's film columns from its user's weighted mean, plain and over max(deviation, 1); null without a preference."""
    rows = candidates.select("user_id", "film_id").join(films, "film_id", "left")
    for name, p in preferences.items():
        rows = rows.join(p.select("user_id", F.col("mean").alias(f"{name}_mean"), F.col("deviation").alias(f"{name}_dev")), "user_id", "left")
    return rows.select("user_id", "film_id", *(c for n in preferences for c in _distance(n)))


def popular_distances(places: Places, depth: int, films: DataFrame, preferences: dict[str, DataFrame]) -> DataFrame:
    """``distance_features`` of every user's first depth unwatched films in popularity order.

    A user's preferences meet the user's row before films are listed, and only films within reach are looked up, so that
    candidates aren't shuffled as rows.
    """
    users = places.users
    for name, p in preferences.items():
        users = users.join(p.select("user_id", F.col("mean").alias(f"{name}_mean"), F.col("deviation").alias(f"{name}_dev")), "user_id", "left")
    rows = popular_lists(places._replace(users=users), depth)
    rows = rows.select("user_id", *(f"{n}_{c}" for n in preferences for c in ("mean", "dev")), F.explode("popular").alias("film_id"))
    rows = rows.join(within_reach(places, films), "film_id", "left")
    return rows.select("user_id", "film_id", *(c for n in preferences for c in _distance(n)))


def feature_matrix(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Feature tables, each unique by its keys among (user_id, film_id), joined to the first one's rows."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, [k for k in keys if k in p.columns], "left")
    return out


def grid_target_ranks(candidates: DataFrame, targets: DataFrame, weights: tuple[float, ...] = WEIGHTS, ks: tuple[int, ...] = KS) -> DataFrame:
    """svd_weight, k, user_id, film_id, rank of each target under each fusion; null if it isn't a candidate.

    A user's candidates meet the user's targets as lists of their ranks; see ``grid_of_lists``.
    """
    lists = candidates.groupBy("user_id").agg(F.collect_list(F.struct("film_id", "svd_rank", "popularity_rank")).alias("c"))
    own = targets.groupBy("user_id").agg(F.collect_set(F.col("film_id").cast("bigint")).alias("wanted"))
    rows = own.join(lists, "user_id", "left")
    film, svd, popular = (F.coalesce(F.transform(f"c.{n}", lambda x: F.coalesce(x.cast("bigint"), F.lit(0).cast("bigint"))), F.array().cast("array<bigint>")) for n in ("film_id", "svd_rank", "popularity_rank"))
    out = grid_of_lists(rows.select("user_id", "wanted", film.alias("film"), svd.alias("svd"), popular.alias("popular")), weights, ks)
    return out.select("user_id", "film_id", F.explode("cells").alias("c")).select("c.svd_weight", "c.k", "user_id", "film_id", "c.rank")


def grid_of_lists(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, ks: tuple[int, ...] = KS) -> DataFrame:
    """user_id, film_id, cells (svd_weight, k, rank) of each wanted film of rows(user_id, wanted, film, svd, popular).

    film, svd and popular are a user's candidates with their ranks, 0 where a source doesn't hold one. A rank is one more than the
    number of the user's candidates that score better, so nothing is sorted and no candidate leaves the user's row.
    """
    cells = [(w, k) for w in weights for k in ks]

    def part(weight: float, k: int, ranks: np.ndarray) -> np.ndarray:
        return np.where(ranks > 0, weight / (k + ranks), 0.0)

    def run(batches):
        for batch in batches:
            users, films, ranks = [], [], []
            for i in range(batch.num_rows):
                wanted, film, svd, popular = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("wanted", "film", "svd", "popular"))
                found = wanted[:, None] == film
                known = found.any(axis=1)
                at = found.argmax(axis=1) if len(film) else np.zeros(len(wanted), np.int64)
                placed = np.zeros((len(wanted), len(cells)), np.int64)
                if known.any():
                    for c, (w, k) in enumerate(cells):
                        s = _rounded(part(w, k, svd) + part(1 - w, k, popular))
                        t = s[at][:, None]
                        placed[:, c] = ((s > t) | ((s == t) & (film < wanted[:, None]))).sum(axis=1) + 1
                placed[~known] = 0
                users.append(np.full(len(wanted), i))
                films.append(wanted)
                ranks.append(placed)
            rank = np.concatenate(ranks).ravel() if ranks else np.zeros(0, np.int64)
            n = len(rank) // len(cells)
            grid = pa.StructArray.from_arrays([pa.array(np.tile([w for w, _ in cells], n).astype(float)), pa.array(np.tile([k for _, k in cells], n).astype(np.int32)), pa.array(rank, mask=rank == 0)], ["svd_weight", "k", "rank"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(cells)), grid)
            owner = np.concatenate(users) if users else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("user_id").take(pa.array(owner)), pa.array(np.concatenate(films) if films else np.zeros(0, np.int64)), lists], ["user_id", "film_id", "cells"])

    return rows.mapInArrow(run, f"user_id {dict(rows.dtypes)['user_id']}, film_id bigint, cells array<struct<svd_weight: double, k: int, rank: bigint>>")


def nearness(weight: Column, k: Column) -> Column:
    """How far a configuration is from equal weights and k = 60."""
    return F.round(F.abs(weight - 0.5), 6) * 1000 + F.abs(k - 60)


def plateau(grid: DataFrame, metric: str = "ndcg_20", tolerance: float = 0.001) -> DataFrame:
    """grid(svd_weight, k, metric) with regret from the best, near (within tolerance) and chosen: of those near, the one nearest to the default."""
    whole = Window.partitionBy()  # a row a configuration
    rows = grid.withColumn("regret", F.round(F.max(metric).over(whole) - F.col(metric), 6)).withColumn("near", F.col("regret") <= tolerance)
    place = F.row_number().over(Window.partitionBy("near").orderBy(nearness(F.col("svd_weight"), F.col("k")), "svd_weight", "k"))
    return rows.withColumn("chosen", F.col("near") & (place == 1)).select("svd_weight", "k", metric, "regret", "near", "chosen")


def lift(report: DataFrame, baseline: str, metric: str = "ndcg_20") -> DataFrame:
    """strategy, absolute and relative difference of a metric to a baseline strategy's; relative is null over zero."""
    base = report.where(F.col("strategy") == baseline).select(F.col(metric).alias("b"))
    d = F.col(metric) - F.col("b")
    return report.crossJoin(F.broadcast(base)).select("strategy", F.round(d, 6).alias("absolute"), F.round(F.when(F.col("b") != 0, d / F.col("b")), 6).alias("relative"))  # one row


def score_distribution(ranked: DataFrame) -> DataFrame:
    """segment, rows, mean and deviation of rrf_score by source membership and by stratum."""
    rows = ranked.select("rrf_score", F.explode(F.array("membership", "stratum")).alias("segment"))
    return rows.groupBy("segment").agg(F.count("*").alias("rows_"), F.round(F.avg("rrf_score"), 6).alias("mean"), F.round(F.stddev_pop("rrf_score"), 6).alias("deviation"))


def shelf_report(shelves: DataFrame, users: DataFrame, strata: DataFrame) -> DataFrame:
    """key, users, activation, mean size, films and the share of HEAD films of shelves(user_id, key, pos, film_id)."""
    n = users.agg(F.count_distinct("user_id").alias("all"))
    rows = shelves.join(strata.select("film_id", "stratum"), "film_id").groupBy("key").agg(
        F.count_distinct("user_id").alias("users"), F.count("*").alias("slots"), F.count_distinct("film_id").alias("films"), F.round(F.avg((F.col("stratum") == "HEAD").cast("double")), 6).alias("head_share")
    )
    return rows.crossJoin(F.broadcast(n)).select("key", "users", F.round(F.col("users") / F.col("all"), 6).alias("activation"), F.round(F.col("slots") / F.col("users"), 6).alias("mean_size"), "films", "head_share")  # one row


def shelf_overlap(shelves: DataFrame, top: int = 20) -> DataFrame:
    """key_a, key_b, users and mean Jaccard similarity of the first rows of two shelves, over users that have both."""
    # A user's first rows are lists in the user's row: pairs of shelves need no join.
    lists = shelves.where(F.col("pos") <= top).groupBy("user_id", "key").agg(F.collect_list("film_id").alias("films"))
    users = lists.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("key", "films"))).alias("l"))
    both = F.flatten(F.transform("l", lambda a: F.transform(F.filter("l", lambda b: a["key"] < b["key"]), lambda b: F.struct(a["key"].alias("key_a"), b["key"].alias("key_b"), F.size(a["films"]).alias("na"), F.size(b["films"]).alias("nb"), F.size(F.array_intersect(a["films"], b["films"])).alias("c")))))
    pairs = users.select(F.explode(both).alias("p")).select("p.*")
    return pairs.groupBy("key_a", "key_b").agg(F.count("*").alias("users"), F.round(F.avg(F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))), 6).alias("jaccard"))


def portfolio_sizes(shelves: DataFrame) -> DataFrame:
    """user_id, categories, slots, films, duplicate_rate and most appearances of one film."""
    # By user and film, then by user: where the rows of a user lie together, neither moves them.
    per = shelves.groupBy("user_id", "film_id").agg(F.count("*").alias("n"), F.collect_set("key").alias("keys"))
    users = per.groupBy("user_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("keys")))).cast("bigint").alias("categories"), F.sum("n").alias("slots"), F.count("*").alias("films"), F.max("n").alias("most"))
    return users.select("user_id", "categories", "slots", "films", F.round(1 - F.col("films") / F.col("slots"), 6).alias("duplicate_rate"), "most")


def threshold_audit(preferences: DataFrame, settings: list[tuple[str, int, int, int]]) -> DataFrame:
    """setting, users and entities that qualify under (name, least support, least positives, least high ratings)."""
    grid = preferences.sparkSession.createDataFrame(settings, "setting string, s int, p int, h int")
    rows = preferences.crossJoin(F.broadcast(grid)).where("affinity > 0 AND support >= s AND positive >= p AND high >= h")  # a few rows
    return rows.groupBy("setting").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("entities"), F.round(F.avg("support"), 6).alias("mean_support"))


def target_scores(profiles: DataFrame, targets: DataFrame, vectors: DataFrame) -> DataFrame:
    """user_id, film_id and the inner product of a target's vector with its user's; null without either."""
    rows = targets.select("user_id", "film_id").join(profiles.select("user_id", F.col("vec").alias("u")), "user_id", "left").join(vectors.select("film_id", F.col("vec").alias("v")), "film_id", "left")
    return rows.select("user_id", "film_id", F.round(dot(F.col("u"), F.col("v")), 6).alias("score"))


def semantic_recall(targets: DataFrame, scopes: dict[str, Column], candidates: DataFrame, shelves: DataFrame) -> DataFrame:
    """key, ranking metrics, retrieved, recommended and both recalls of each shelf over the targets in its scope.

    targets(user_id, film_id, ...) has the columns of the scopes, of which null counts as false; shelves(key, user_id, film_id, rank).
    A target that its shelf doesn't hold counts as zero in the metrics.
    """
    keys = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in scopes.items())), lambda k: k.isNotNull())
    rows = targets.select("user_id", "film_id", F.explode(keys).alias("key")).join(shelves, ["key", "user_id", "film_id"], "left")
    rows = rows.join(candidates.select("user_id", "film_id", F.lit(True).alias("got")), ["user_id", "film_id"], "left")
    n = F.count("*")
    found = rows.groupBy("key").agg(F.count("got").alias("retrieved"), F.count("rank").alias("recommended"), F.round(F.count("got") / n, 6).alias("candidate_recall"), F.round(F.count("rank") / n, 6).alias("category_recall"))
    return metrics(rows, ["key"]).join(found, "key")


def variant_report(shelves: DataFrame) -> DataFrame:
    """variant, key, users, slots, films and the share of HEAD films of shelves(variant, key, user_id, film_id, head)."""
    return shelves.groupBy("variant", "key").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("slots"), F.count_distinct("film_id").alias("films"), F.round(F.avg(F.col("head").cast("double")), 6).alias("head_share"))
