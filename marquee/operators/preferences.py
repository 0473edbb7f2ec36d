"""User history profiles and entity preferences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import ratings as R
from marquee.operators.ranking import small
from marquee.sources.work import saved

#: Ratings by entity that a task holds, about.
HELD = 1 << 21


@dataclass(frozen=True)
class Policy:
    """Thresholds of the shelves and the portfolio; the defaults are fixed values."""

    rrf_k: int = 60
    maximum_categories: int = 10
    shelf_maximum: int = 20
    director_smoothing: float = 5.0
    broad_smoothing: float = 4.0
    director_support: int = 2
    director_positive: int = 2
    director_high: int = 1
    director_negative_fraction: float = 0.25
    broad_support: int = 5
    broad_positive_fraction: float = 0.70
    broad_high: int = 2
    hidden_minimum: int = 12
    hidden_mid_rank: int = 500
    hidden_tail_rank: int = 250
    hidden_positives: int = 3
    national_minimum: int = 8
    national_countries: tuple[str, ...] = ("brazil", "brasil")
    national_languages: tuple[str, ...] = ("portuguese", "no spoken language")
    anchor_minimum: int = 8
    anchor_neighbours: int | None = 100
    anchor_fraction: float | None = None
    directors_minimum: int = 8
    director_pool: int = 15
    director_films: int = 3
    genre_minimum: int = 12
    decade_minimum: int = 12
    world_minimum: int = 12
    world_countries: int = 5
    world_country_cap: int = 5
    world_rank: int = 500
    world_head_cap: int | None = 12
    english_languages: tuple[str, ...] = ("english",)
    english_countries: tuple[str, ...] = ("usa", "uk", "canada", "australia", "new zealand", "ireland", "english")
    no_language: tuple[str, ...] = ("no spoken language",)
    outside_minimum: int = 12
    outside_svd_rank: int = 750
    outside_rrf_rank: int = 1250
    outside_primary_svd_rank: int = 500
    outside_primary_rrf_rank: int = 1000
    outside_primary: bool = True
    outside_families: int = 2
    outside_familiar: int = 1
    outside_no_head: bool = False
    outside_no_hidden: bool = True
    outside_head_cap: int = 4
    outside_head_rank: int = 100
    classic_year: int = 1969
    classic_minimum: int = 8
    classic_head_cap: int | None = 12
    overlap: float = 0.70
    appearances: int = 2
    reserved: int = 10
    generic_director_cap: int = 3
    generic_decade_cap: int = 6
    generic_genre_cap: int = 8
    sparse_rated: int = 5
    deep_watched: int = 2000


DEFAULT = Policy()
#: The earlier policy, kept to compare with.
FIRST = Policy(anchor_neighbours=None, world_head_cap=None, outside_svd_rank=500, outside_rrf_rank=1000, outside_primary=False, outside_no_head=True, outside_no_hidden=False, outside_head_cap=0, classic_head_cap=None)


def profiles(logs: DataFrame, model_films: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """A row per user: watched, rated, mean_rating, positive, indexed_positive, high and negative counts, and depth_band."""
    r = F.col("rating")
    known = logs.join(model_films.select("film_id", F.lit(True).alias("known")), "film_id", "left")
    out = known.groupBy("user_id").agg(
        F.count("*").alias("watched"), F.count("rating").alias("rated"), F.round(F.avg("rating"), 6).alias("mean_rating"), F.count_if(r >= R.POSITIVE).alias("positive"),
        F.count_if((r >= R.POSITIVE) & F.col("known")).alias("indexed_positive"), F.count_if(r >= R.HIGH).alias("high"), F.count_if(r <= R.NEGATIVE).alias("negative"),
    )
    return out.withColumn("depth_band", R.depth_band(F.col("rated"), F.col("watched"), policy.sparse_rated, policy.deep_watched))


def entity_ratings(rated: DataFrame, film_entity: DataFrame) -> DataFrame:
    """A row per rating and entity of its film, all of a user in one partition: user_id, rating, family, entity_id, name.

    What is shuffled by user is a row a rating with its film's entities as numbers; these are looked up afterwards.
    """
    keys = ["family", "entity_id", "name"]
    entity = saved(film_entity.select("film_id", *keys))
    names = small(saved(entity.select(*keys).distinct().withColumn("code", F.monotonically_increasing_id())))
    same = F.lit(True)
    for c in keys:
        same = same & entity[c].eqNullSafe(names[c])
    films = entity.join(names, same).groupBy("film_id").agg(F.collect_list("code").alias("codes"))
    count = int(rated.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = entity.count() / max(entity.select("film_id").distinct().count(), 1)
    tasks = max(count, int(rated.count() * each / HELD))  # rows grow behind the shuffle, so their number is set here
    rows = rated.select("user_id", "film_id", "rating").join(films, "film_id").select("user_id", "rating", "codes").repartition(tasks, "user_id")
    return rows.select("user_id", "rating", F.explode("codes").alias("code")).join(names, "code").drop("code")


def entity_preferences(logs: DataFrame, film_entity: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """A row per (user, family, entity): support, counts, fractions, raw preference, confidence and affinity."""
    rated = logs.where("rating IS NOT NULL")
    mean = rated.groupBy("user_id").agg(F.avg("rating").alias("user_mean"))
    r, smooth = F.col("rating"), F.when(F.col("family") == "director", policy.director_smoothing).otherwise(policy.broad_smoothing)
    own = entity_ratings(rated, film_entity).groupBy("user_id", "family", "entity_id").agg(
        F.max("name").alias("name"), F.count("*").alias("support"), F.avg("rating").alias("entity_mean"), F.count_if(r >= R.POSITIVE).alias("positive"), F.count_if(r >= R.HIGH).alias("high"), F.count_if(r <= R.NEGATIVE).alias("negative")
    )
    raw = F.col("entity_mean") - F.col("user_mean")
    confidence = F.col("support") / (F.col("support") + smooth)
    return own.join(mean, "user_id").select(
        "user_id", "family", "entity_id", "name", "support", F.round("entity_mean", 6).alias("entity_mean"), "positive", "high", "negative", F.round(F.col("positive") / F.col("support"), 6).alias("positive_fraction"),
        F.round(F.col("negative") / F.col("support"), 6).alias("negative_fraction"), F.round(raw, 6).alias("raw_preference"), F.round(confidence, 6).alias("confidence"), F.round(raw * confidence, 6).alias("affinity"),
    )


def qualified(preferences: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Preferences strong enough for a shelf, with place by (affinity, support, mean descending, id) within user and family, and tier."""
    director = (F.col("support") >= policy.director_support) & (F.col("positive") >= policy.director_positive) & (F.col("high") >= policy.director_high) & (F.col("negative_fraction") <= policy.director_negative_fraction)
    broad = (F.col("support") >= policy.broad_support) & (F.col("positive_fraction") >= policy.broad_positive_fraction) & (F.col("high") >= policy.broad_high)
    is_director = F.col("family") == "director"
    good = preferences.where((F.col("affinity") > 0) & F.when(is_director, director).otherwise(broad))
    order = Window.partitionBy("user_id", "family").orderBy(F.col("affinity").desc(), F.col("support").desc(), F.col("entity_mean").desc(), "entity_id")
    minimum = F.when(is_director, policy.director_support).otherwise(policy.broad_support)
    return good.withColumn("place", F.row_number().over(order)).withColumn("tier", R.evidence_tier(F.col("support"), minimum))


def top_entities(preferences: DataFrame, k: int) -> DataFrame:
    """The k entities of greatest affinity in each family of each user."""
    order = Window.partitionBy("user_id", "family").orderBy(F.col("affinity").desc(), F.col("support").desc(), F.col("entity_mean").desc(), "entity_id")
    return preferences.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def anchors(logs: DataFrame, model_films: DataFrame) -> DataFrame:
    """user_id, film_id, rating, place: films of the model rated 4.0 or more, best first."""
    order = Window.partitionBy("user_id").orderBy(F.col("rating").desc(), "film_id")
    return logs.where(F.col("rating") >= R.ANCHOR_FALLBACK).join(model_films.select("film_id"), "film_id", "left_semi").select("user_id", "film_id", "rating", F.row_number().over(order).alias("place"))
