"""Shelves: one row per (user_id, key, pos, film_id) from the ranked inventory of a user.

ranked has user_id, film_id, svd_score, svd_rank, popularity_rank, rrf_score, rrf_rank, membership and stratum.
Films that shelves may not fill with popular titles alone carry head (a HEAD film) and the shelf its head_cap.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import ratings as R
from marquee.operators.preferences import DEFAULT, Policy, qualified, top_entities

# Fixed shelf keys, roles and titles.
ROLES = {
    "top_picks": "general", "hidden_gems": "discovery", "brazilian_cinema": "cultural", "because_you_liked": "personalized", "directors_you_love": "personalized",
    "favorite_genre": "personalized", "favorite_decade": "personalized", "world_cinema": "cultural", "outside_usual": "serendipity", "classic_cinema": "cultural",
}
TITLES = {
    "top_picks": "Top Picks for You", "hidden_gems": "Hidden Gems for You", "brazilian_cinema": "Brazilian Cinema", "because_you_liked": "Because You Liked {entity}", "directors_you_love": "From Directors You Love",
    "favorite_genre": "{entity} Picks for You", "favorite_decade": "{entity} Picks for You", "world_cinema": "World Cinema for You", "outside_usual": "Outside Your Usual", "classic_cinema": "Classic Cinema",
}


def positive_svd() -> Column:
    return F.col("svd_rank").isNotNull() & (F.col("svd_score") > 0)


def hidden_neighbourhood(policy: Policy = DEFAULT) -> Column:
    mid = (F.col("stratum") == "MID") & (F.col("svd_rank") <= policy.hidden_mid_rank)
    tail = (F.col("stratum") == "TAIL") & (F.col("svd_rank") <= policy.hidden_tail_rank)
    return positive_svd() & (mid | tail) & (F.col("indexed_positive") >= policy.hidden_positives)


def shelf(rows: DataFrame, key: str, minimum: int, policy: Policy, order: list[Column], tier: Column | str = "minimum", support: Column | int = 0, head_cap: int | None = None, entity: Column | None = None) -> DataFrame:
    """Orders a shelf's rows and drops the shelf of a user with fewer than minimum."""
    place = Window.partitionBy("user_id").orderBy(*order)
    size = F.count("*").over(Window.partitionBy("user_id"))
    return rows.withColumn("__size", size).where(F.col("__size") >= minimum).select(
        "user_id", F.lit(key).alias("key"), F.row_number().over(place).alias("pos"), "film_id", F.lit(ROLES[key]).alias("role"), (F.lit(tier) if isinstance(tier, str) else tier).alias("tier"),
        (F.lit(support) if isinstance(support, int) else support).cast("bigint").alias("support"), F.lit(minimum).alias("minimum"), F.lit(policy.shelf_maximum).alias("maximum"),
        (F.col("stratum") == "HEAD").alias("head"), F.lit(head_cap).cast("int").alias("head_cap"), (entity if entity is not None else F.lit(None)).cast("string").alias("entity"),
    )


def top_picks(ranked: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    return shelf(ranked, "top_picks", 1, policy, [F.col("rrf_rank")], "strong")


def hidden_gems(ranked: DataFrame, users: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    rows = ranked.join(users.select("user_id", "indexed_positive"), "user_id").where(hidden_neighbourhood(policy))
    tier = R.evidence_tier(F.col("indexed_positive"), policy.hidden_positives)
    return shelf(rows, "hidden_gems", policy.hidden_minimum, policy, [F.col("rrf_rank")], tier, F.col("indexed_positive"))


def _film_names(film_entity: DataFrame, family: str, names: tuple[str, ...]) -> DataFrame:
    return film_entity.where((F.col("family") == family) & F.lower("name").isin(*names)).select("film_id").distinct()


BY_RANKS = ["rrf_rank", "svd_rank", "film_id"]


def national_cinema(ranked: DataFrame, film_entity: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    rows = ranked.where(positive_svd())
    for family, names in (("country", policy.national_countries), ("language", policy.national_languages)):
        rows = rows.join(_film_names(film_entity, family, names), "film_id", "left_semi")
    return shelf(rows, "brazilian_cinema", policy.national_minimum, policy, [F.col(c) for c in BY_RANKS])


def neighbourhoods(ranked: DataFrame, anchor_rows: DataFrame, vectors: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """user_id, anchor_id, rating, film_id, similarity, place, rrf_rank, stratum: the nearest candidates of each of a user's anchors of the greatest rating.

    One product of matrices a user, in whose task only the user's own anchors and candidates meet; what the policy keeps leaves it.
    """
    high = F.max("rating").over(Window.partitionBy("user_id"))
    best = anchor_rows.withColumn("__most", high).where(F.col("rating") == F.col("__most"))
    a = best.join(vectors.select("film_id", "vec"), "film_id").select(F.col("user_id").cast("bigint").alias("user_id"), F.col("film_id").cast("bigint").alias("film_id"), F.col("rating").cast("double").alias("rating"), F.col("vec").alias("x"))
    c = ranked.join(vectors.select("film_id", "vec"), "film_id").select(F.col("user_id").cast("bigint").alias("user_id"), F.col("film_id").cast("bigint").alias("film_id"), F.col("rrf_rank").cast("bigint").alias("rrf_rank"), "stratum", F.col("vec").alias("y"))
    names = ["user_id", "anchor_id", "rating", "film_id", "similarity", "place", "rrf_rank", "stratum"]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in types], names)
        x, y = (np.asarray(t[c].combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1) for t, c in ((left, "x"), (right, "y")))
        film, rank = right["film_id"].to_numpy(), right["rrf_rank"].to_numpy()
        near = np.round(x @ y.T, 6)
        if policy.anchor_neighbours is not None:
            keep = np.full(len(x), min(policy.anchor_neighbours, len(y)))
        elif policy.anchor_fraction is not None:
            keep = np.full(len(x), min(len(y), max(policy.anchor_minimum, int(np.ceil(len(y) * policy.anchor_fraction)))))
        else:
            keep = (near > 0).sum(axis=1)
        order = np.concatenate([np.lexsort((film, rank, -row))[:k] for row, k in zip(near, keep, strict=True)])
        who = np.repeat(np.arange(len(x)), keep)
        place = np.concatenate([np.arange(1, k + 1) for k in keep])
        out = [left["user_id"].combine_chunks().take(pa.array(who)), left["film_id"].combine_chunks().take(pa.array(who)), left["rating"].combine_chunks().take(pa.array(who)), film[order], near[who, order], place, rank[order], right["stratum"].combine_chunks().take(pa.array(order))]
        return pa.table([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(out, types, strict=True)], names)

    schema = "user_id bigint, anchor_id bigint, rating double, film_id bigint, similarity double, place bigint, rrf_rank bigint, stratum string"
    return a.groupBy("user_id").cogroup(c.groupBy("user_id")).applyInArrow(run, schema)


def chosen_anchors(near: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """user_id, anchor_id, rating, mean (similarity of the twenty nearest), size, overlap (of these with the first twenty candidates): each user's best anchor."""
    first = F.col("place") <= 20
    inside = F.count_if(first & (F.col("rrf_rank") <= 20))
    stats = near.groupBy("user_id", "anchor_id", "rating").agg(F.count("*").alias("size"), F.round(F.avg(F.when(first, F.col("similarity"))), 6).alias("mean"), (inside / (F.count_if(first) + 20 - inside)).alias("overlap"))
    stats = stats.where(F.col("size") >= policy.anchor_minimum)
    choice = stats.groupBy("user_id").agg(F.min(F.struct((-F.col("rating")).alias("r"), (-F.col("mean")).alias("m"), (-F.col("size")).alias("s"), "overlap", "anchor_id")).alias("c"))
    return choice.select("user_id", "c.anchor_id", (-F.col("c.r")).alias("rating"), (-F.col("c.m")).alias("mean"), (-F.col("c.s")).alias("size"), "c.overlap")


def because_you_liked(ranked: DataFrame, anchor_rows: DataFrame, vectors: DataFrame, titles: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The neighbourhood of the best anchor: of the greatest rating, then of the greatest mean similarity of its twenty nearest."""
    near = neighbourhoods(ranked, anchor_rows, vectors, policy)
    rows = near.join(chosen_anchors(near, policy).select("user_id", "anchor_id"), ["user_id", "anchor_id"]).join(titles.select(F.col("film_id").alias("anchor_id"), "title"), "anchor_id", "left")
    tier = F.when(F.col("rating") >= R.ANCHOR, "strong").otherwise("minimum")
    return shelf(rows, "because_you_liked", policy.anchor_minimum, policy, [F.col("similarity").desc(), F.col("rrf_rank"), F.col("film_id")], tier, 1, None, F.col("title"))


def directors_you_love(ranked: DataFrame, film_entity: DataFrame, good: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    pool = good.where((F.col("family") == "director") & (F.col("place") <= policy.director_pool))
    support = pool.groupBy("user_id").agg(F.sum("support").alias("pool_support"), F.max(F.when(F.col("tier") == "strong", 1).otherwise(0)).alias("strong"))
    films = ranked.join(film_entity.where("family = 'director'").select("film_id", "entity_id"), "film_id").join(pool.select("user_id", "entity_id", "affinity", "support"), ["user_id", "entity_id"])
    one = F.row_number().over(Window.partitionBy("user_id", "film_id").orderBy(F.col("affinity").desc(), F.col("support").desc(), "entity_id"))
    films = films.withColumn("__one", one).where("__one = 1").drop("support")
    few = F.row_number().over(Window.partitionBy("user_id", "entity_id").orderBy("rrf_rank"))
    rows = films.withColumn("__few", few).where(F.col("__few") <= policy.director_films).join(support, "user_id")
    return shelf(rows, "directors_you_love", policy.directors_minimum, policy, [F.col("rrf_rank")], F.when(F.col("strong") == 1, "strong").otherwise("minimum"), F.col("pool_support"))


def favorite(ranked: DataFrame, film_entity: DataFrame, good: DataFrame, family: str, policy: Policy = DEFAULT) -> DataFrame:
    """Films of the strongest qualified genre or decade."""
    best = good.where((F.col("family") == family) & (F.col("place") == 1)).select("user_id", "entity_id", "name", "support", "tier")
    rows = ranked.join(film_entity.where(F.col("family") == family).select("film_id", "entity_id"), "film_id").join(best, ["user_id", "entity_id"])
    return shelf(rows, f"favorite_{family}", policy.genre_minimum if family == "genre" else policy.decade_minimum, policy, [F.col("rrf_rank")], F.col("tier"), F.col("support"), None, F.col("name"))


def world_eligible(ranked: DataFrame, film_entity: DataFrame, good: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """ranked rows of world cinema with countries (sorted ids), before the cap per country, and the strength of the user's countries."""
    country, language = film_entity.where("family = 'country'"), film_entity.where("family = 'language'")
    abroad = country.where(~F.lower("name").isin(*policy.english_countries)).select("film_id").distinct()
    other = language.where(~F.lower("name").isin(*policy.english_languages, *policy.no_language)).select("film_id").distinct()
    world = abroad.join(other, "film_id").join(_film_names(film_entity, "language", policy.english_languages), "film_id", "left_anti")
    fits = ~F.when(F.col("family") == "country", F.lower("name").isin(*policy.english_countries)).otherwise(F.lower("name").isin(*policy.english_languages, *policy.no_language))
    again = F.row_number().over(Window.partitionBy("user_id", "family").orderBy("place"))
    liked = good.where(F.col("family").isin("country", "language") & fits).withColumn("__p", again).where((F.col("family") == "language") | (F.col("__p") <= policy.world_countries))
    strength = liked.where("family = 'country'").groupBy("user_id").agg(F.sum("support").alias("country_support"))
    rows = ranked.join(world, "film_id")
    matched = rows.join(film_entity.select("film_id", "family", "entity_id"), "film_id").join(liked.select("user_id", "family", "entity_id"), ["user_id", "family", "entity_id"], "left_semi").select("user_id", "film_id").distinct().withColumn("matched", F.lit(True))
    listed = country.groupBy("film_id").agg(F.array_sort(F.collect_set("entity_id")).alias("countries"))
    out = rows.join(matched, ["user_id", "film_id"], "left").join(listed, "film_id").join(strength, "user_id", "left")
    return out.where(F.col("matched") | (positive_svd() & (F.col("svd_rank") <= policy.world_rank)))


def capped_countries(rows: DataFrame, cap: int) -> DataFrame:
    """rows(user_id, film_id, rrf_rank, countries) whose countries aren't all used up, in rank order; each taken film is charged to its least used country."""

    def take(frame: pd.DataFrame) -> pd.DataFrame:
        used: dict[int, int] = {}
        keep = []
        for film, ids in frame.sort_values("rrf_rank")[["film_id", "countries"]].itertuples(index=False):
            if all(used.get(i, 0) >= cap for i in ids):
                continue
            least = min(ids, key=lambda i: (used.get(i, 0), i))
            used[least] = used.get(least, 0) + 1
            keep.append(film)
        return pd.DataFrame({"user_id": np.full(len(keep), frame["user_id"].iloc[0], "int64"), "film_id": np.array(keep, "int64")})

    return rows.select("user_id", "film_id", "rrf_rank", "countries").groupBy("user_id").applyInPandas(take, "user_id bigint, film_id bigint")


def world_cinema(ranked: DataFrame, film_entity: DataFrame, good: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    rows = world_eligible(ranked, film_entity, good, policy)
    rows = rows.join(capped_countries(rows, policy.world_country_cap), ["user_id", "film_id"], "left_semi")
    tier = F.when(F.col("country_support").isNotNull(), "strong").otherwise("minimum")
    return shelf(rows, "world_cinema", policy.world_minimum, policy, [F.col("rrf_rank")], tier, F.coalesce("country_support", F.lit(0)), policy.world_head_cap)


def outside_usual(ranked: DataFrame, users: DataFrame, film_entity: DataFrame, preferences: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    familiar = top_entities(preferences.where("affinity > 0"), policy.outside_familiar)
    enough = familiar.groupBy("user_id").agg(F.count_distinct("family").alias("families")).where(F.col("families") >= policy.outside_families)
    rows = ranked.join(enough, "user_id").join(users.select("user_id", "indexed_positive"), "user_id").where(positive_svd() & (F.col("rrf_rank") <= policy.outside_rrf_rank))
    seen = rows.select("user_id", "film_id").join(film_entity.select("film_id", "family", "entity_id"), "film_id").join(familiar.select("user_id", "family", "entity_id"), ["user_id", "family", "entity_id"], "left_semi")
    rows = rows.join(seen.select("user_id", "film_id").distinct(), ["user_id", "film_id"], "left_anti")
    head = F.col("stratum") == "HEAD"
    if policy.outside_no_head:
        rows = rows.where(~head & (F.col("svd_rank") <= policy.outside_svd_rank))
    else:
        rows = rows.where(F.when(head, (F.col("membership") == "svd_only") & (F.col("svd_rank") <= policy.outside_head_rank)).otherwise(F.col("svd_rank") <= policy.outside_svd_rank))
    if policy.outside_no_hidden:
        rows = rows.where(~F.coalesce(hidden_neighbourhood(policy), F.lit(False)))
    if policy.outside_primary:
        primary = ~head & (F.col("svd_rank") <= policy.outside_primary_svd_rank) & (F.col("rrf_rank") <= policy.outside_primary_rrf_rank)
        rows = rows.withColumn("__primary", F.count_if(primary).over(Window.partitionBy("user_id"))).where(F.col("__primary") >= policy.outside_minimum)
    return shelf(rows, "outside_usual", policy.outside_minimum, policy, [F.col("svd_rank"), F.col("rrf_rank"), F.col("film_id")], "minimum", F.col("families"), policy.outside_head_cap)


def classic_cinema(ranked: DataFrame, films: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    rows = ranked.where(positive_svd()).join(films.where(F.col("year") <= policy.classic_year).select("film_id"), "film_id", "left_semi")
    return shelf(rows, "classic_cinema", policy.classic_minimum, policy, [F.col(c) for c in BY_RANKS], head_cap=policy.classic_head_cap)


def all_shelves(ranked: DataFrame, users: DataFrame, preferences: DataFrame, anchor_rows: DataFrame, film_entity: DataFrame, films: DataFrame, vectors: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Every shelf of every user."""
    good = qualified(preferences, policy)
    parts = [
        top_picks(ranked, policy), hidden_gems(ranked, users, policy), national_cinema(ranked, film_entity, policy), because_you_liked(ranked, anchor_rows, vectors, films, policy),
        directors_you_love(ranked, film_entity, good, policy), favorite(ranked, film_entity, good, "genre", policy), favorite(ranked, film_entity, good, "decade", policy),
        world_cinema(ranked, film_entity, good, policy), outside_usual(ranked, users, film_entity, preferences, policy), classic_cinema(ranked, films, policy),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def unavailable(shelves: DataFrame, users: DataFrame) -> DataFrame:
    """user_id and the sorted keys that a user has no shelf of."""
    have = shelves.groupBy("user_id").agg(F.collect_set("key").alias("have"))
    keys = F.array(*map(F.lit, sorted(ROLES)))
    return users.select("user_id").join(have, "user_id", "left").select("user_id", F.array_except(keys, F.coalesce("have", F.array().cast("array<string>"))).alias("keys"))
