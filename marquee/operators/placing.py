"""Shelves of all users in one pass over candidates that stay with their user: conditions and running counts instead of joins and sorts by shelf.

The shelves are those of ``shelves``, of the same columns; what films and users bring along comes as a row a film and a row a user.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import ratings as R
from marquee.operators import shelves as S
from marquee.operators.preferences import DEFAULT, Policy, qualified
from marquee.operators.ranking import small
from marquee.sources.work import saved

#: What a film on a shelf keeps of the candidate.
RANKS = ("svd_rank", "rrf_rank", "membership", "stratum")
#: Users whose neighbours are found at a time, and items of a block.
USERS, ITEMS = 512, 16384


def _code() -> Column:
    return F.concat("family", F.lit(":"), F.col("entity_id").cast("string"))


def film_facts(strata: DataFrame, films: DataFrame, film_entity: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """A row a film of strata: stratum, year, title, sorted ids of directors, genres, decades and countries, codes of all entities, and whether it is of national or world cinema."""
    name, family = F.lower("name"), F.col("family")
    some = lambda f, test: F.coalesce(F.max((family == f) & test), F.lit(False))
    ids = {n: F.array_sort(F.collect_set(F.when(family == f, F.col("entity_id")))) for n, f in (("directors", "director"), ("genres", "genre"), ("decades", "decade"), ("countries", "country"))}
    national = some("country", name.isin(*policy.national_countries)) & some("language", name.isin(*policy.national_languages))
    english = some("language", name.isin(*policy.english_languages))
    world = some("country", ~name.isin(*policy.english_countries)) & some("language", ~name.isin(*policy.english_languages, *policy.no_language)) & ~english
    found = film_entity.groupBy("film_id").agg(*(c.alias(n) for n, c in ids.items()), F.collect_set(_code()).alias("codes"), national.alias("national"), world.alias("world"))
    own = films.groupBy("film_id").agg(F.min("year").alias("year"))
    rows = strata.select("film_id", "stratum").join(own, "film_id", "left").join(found, "film_id", "left")
    none = {**{n: F.array().cast("array<bigint>") for n in ids}, "codes": F.array().cast("array<string>"), "national": F.lit(False), "world": F.lit(False)}
    return rows.select("film_id", "stratum", "year", *(F.coalesce(n, c).alias(n) for n, c in none.items()))


def tastes(preferences: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """A row a user with a preference of positive affinity: the strongest genre and decade, qualified directors by place, codes of liked countries and languages with country_support, codes of familiar entities and their families."""
    keys = Window.partitionBy("user_id", "family")
    first = keys.orderBy(F.col("affinity").desc(), F.col("support").desc(), F.col("entity_mean").desc(), "entity_id")
    rows = qualified(preferences, policy).select("user_id", "family", "entity_id", "affinity", "support", "name", "place", "tier", F.lit(None).cast("int").alias("known"))
    family, name, place = F.col("family"), F.lower("name"), F.col("place")
    fits = F.when(family == "country", ~name.isin(*policy.english_countries)).when(family == "language", ~name.isin(*policy.english_languages, *policy.no_language))
    rows = rows.withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("again", F.count_if("fits").over(keys.orderBy("place")))
    rows = rows.withColumn("liked", F.col("fits") & ((family == "language") | (F.col("again") <= policy.world_countries)))
    known = preferences.where("affinity > 0").withColumn("known", F.row_number().over(first)).where(F.col("known") <= policy.outside_familiar).select("user_id", "family", "entity_id", "known")
    best = lambda f: F.max(F.when((family == f) & (place == 1), F.struct("entity_id", "name", "support", "tier")))
    pool = F.collect_list(F.when(family == "director", F.struct("place", (-F.col("affinity")).alias("a"), (-F.col("support")).alias("s"), "entity_id", (F.col("tier") == "strong").alias("strong"))))
    return rows.unionByName(known, allowMissingColumns=True).groupBy("user_id").agg(
        best("genre").alias("genre"), best("decade").alias("decade"), pool.alias("pool"), F.collect_set(F.when(F.col("liked"), _code())).alias("liked"),
        F.sum(F.when(F.col("liked") & (family == "country"), F.col("support"))).alias("country_support"), F.collect_set(F.when(F.col("known").isNotNull(), _code())).alias("familiar"), F.count_distinct(F.when(F.col("known").isNotNull(), family)).alias("families"),
    )


TASTED = {"directors_you_love", "favorite_genre", "favorite_decade", "world_cinema", "outside_usual"}
COUNTED = {"hidden_gems", "outside_usual"}


def candidates_with_facts(ranked: DataFrame, facts: DataFrame, users: DataFrame, taste: DataFrame | None, keys: set[str], policy: Policy = DEFAULT) -> DataFrame:
    """ranked with the facts of films, few enough to be sent, and what the shelves in keys need of the user; rows stay with their user."""
    rows = ranked.drop("stratum").join(facts, "film_id")
    if keys & COUNTED:
        rows = rows.join(users.select("user_id", "indexed_positive"), "user_id")
    if keys & TASTED:
        pool = F.filter("pool", lambda x: x["place"] <= policy.director_pool)
        mine = taste.withColumn("pool", pool).select(
            "user_id", "genre", "decade", "liked", "country_support", "familiar", "families", F.transform(F.array_sort(F.transform("pool", lambda x: F.struct(x["a"], x["s"], x["entity_id"]))), lambda x: x["entity_id"]).alias("loved"),
            (-F.aggregate("pool", F.lit(0).cast("bigint"), lambda s, x: s + x["s"])).alias("pool_support"), F.exists("pool", lambda x: x["strong"]).alias("pool_strong"),
        )
        rows = rows.join(mine, "user_id", "left")
    return rows


def world_eligible(rows: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The rows of ``candidates_with_facts`` of world cinema before the cap per country, with matched."""
    matched = F.coalesce(F.arrays_overlap("codes", "liked"), F.lit(False))
    return rows.withColumn("matched", matched).where(F.col("world") & (F.col("matched") | (S.positive_svd() & (F.col("svd_rank") <= policy.world_rank))))


def _conditions(policy: Policy) -> dict[str, tuple]:
    """key: condition, minimum, tier, support, head_cap, entity."""
    loved = F.array_intersect("loved", "directors")
    near = S.positive_svd()
    head = F.col("stratum") == "HEAD"
    outside = near & (F.col("rrf_rank") <= policy.outside_rrf_rank) & (F.col("families") >= policy.outside_families) & ~F.coalesce(F.arrays_overlap("codes", "familiar"), F.lit(False))
    if policy.outside_no_head:
        outside = outside & ~head & (F.col("svd_rank") <= policy.outside_svd_rank)
    else:
        outside = outside & F.when(head, (F.col("membership") == "svd_only") & (F.col("svd_rank") <= policy.outside_head_rank)).otherwise(F.col("svd_rank") <= policy.outside_svd_rank)
    if policy.outside_no_hidden:
        outside = outside & ~F.coalesce(S.hidden_neighbourhood(policy), F.lit(False))
    favorite = lambda f, minimum: (F.array_contains(f"{f}s", F.col(f"{f}.entity_id")), minimum, F.col(f"{f}.tier"), F.col(f"{f}.support"), None, F.col(f"{f}.name"))
    return {
        "top_picks": (F.lit(True), 1, "strong", 0, None, None),
        "hidden_gems": (S.hidden_neighbourhood(policy), policy.hidden_minimum, R.evidence_tier(F.col("indexed_positive"), policy.hidden_positives), F.col("indexed_positive"), None, None),
        "brazilian_cinema": (near & F.col("national"), policy.national_minimum, "minimum", 0, None, None),
        "directors_you_love": (F.size(loved) > 0, policy.directors_minimum, F.when(F.col("pool_strong"), "strong").otherwise("minimum"), F.col("pool_support"), None, None),
        "favorite_genre": favorite("genre", policy.genre_minimum),
        "favorite_decade": favorite("decade", policy.decade_minimum),
        "outside_usual": (outside, policy.outside_minimum, "minimum", F.col("families"), policy.outside_head_cap, None),
        "classic_cinema": (near & (F.col("year") <= policy.classic_year), policy.classic_minimum, "minimum", 0, policy.classic_head_cap, None),
    }


def _entry(key: str, pos: Column, minimum: int, tier: Column | str, support: Column | int, cap: int | None, entity: Column | None, policy: Policy) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(key).alias("key"), pos.cast("int").alias("pos"), F.lit(S.ROLES[key]).alias("role"), lit(tier).alias("tier"), lit(support).cast("bigint").alias("support"), F.lit(minimum).alias("minimum"), F.lit(policy.shelf_maximum).alias("maximum"),
        F.lit(cap).cast("int").alias("head_cap"), lit(entity).cast("string").alias("entity"),
    )


def _columns(rows: DataFrame) -> DataFrame:
    return rows.select("user_id", "x.key", "x.pos", "film_id", "x.role", "x.tier", "x.support", "x.minimum", "x.maximum", (F.col("stratum") == "HEAD").alias("head"), "x.head_cap", "x.entity", *RANKS)


def placed(rows: DataFrame, keys: set[str], policy: Policy = DEFAULT) -> DataFrame:
    """The shelves in keys but world cinema and the anchors' of ``candidates_with_facts``, with ``RANKS``. Places are running counts in one order of a user's rows, so that all shelves share it."""
    some = {k: v for k, v in _conditions(policy).items() if k in keys}
    if not some:
        raise ValueError("no shelf to place")
    named = {"director": F.get(F.array_intersect("loved", "directors"), F.lit(0))} if "directors_you_love" in some else {}
    # What a shelf says of its user is a column of its own; arrays end here.
    flat = {f"{n}_{k}": c for k, (_, _, tier, support, _, entity) in some.items() for n, c in (("tier", tier), ("support", support), ("entity", entity)) if isinstance(c, Column)}
    rows = rows.select("user_id", "film_id", *RANKS, *(F.coalesce(c[0], F.lit(False)).alias(f"in_{k}") for k, c in some.items()), *(c.alias(n) for n, c in (named | flat).items()))
    inside = {k: F.col(f"in_{k}") for k in some}
    rows = rows.where(functools.reduce(Column.__or__, inside.values()))
    user = Window.partitionBy("user_id")
    if "directors_you_love" in some:
        few = F.row_number().over(Window.partitionBy("user_id", "director").orderBy("rrf_rank"))
        rows = rows.withColumn("__few", few).withColumn("in_directors_you_love", inside["directors_you_love"] & (F.col("__few") <= policy.director_films)).drop("__few")
    if "outside_usual" in some and policy.outside_primary:
        primary = inside["outside_usual"] & (F.col("stratum") != "HEAD") & (F.col("svd_rank") <= policy.outside_primary_svd_rank) & (F.col("rrf_rank") <= policy.outside_primary_rrf_rank)
        rows = rows.withColumn("__p", F.count_if(primary).over(user)).withColumn("in_outside_usual", inside["outside_usual"] & (F.col("__p") >= policy.outside_minimum)).drop("__p")
    orders = {k: ["svd_rank", "rrf_rank", "film_id"] if k == "outside_usual" else ["rrf_rank"] for k in some}
    rows = rows.withColumns({f"n_{k}": F.count_if(c).over(user) for k, c in inside.items()})
    rows = rows.withColumns({f"at_{k}": F.count_if(c).over(user.orderBy(*orders[k]).rowsBetween(Window.unboundedPreceding, 0)) for k, c in inside.items()})
    each = []
    for k, (_, minimum, *said, cap, entity) in some.items():
        tier, support, entity = (F.col(f"{n}_{k}") if f"{n}_{k}" in flat else v for n, v in zip(("tier", "support", "entity"), (*said, entity), strict=True))
        each.append(F.when(inside[k] & (F.col(f"n_{k}") >= minimum), _entry(k, F.col(f"at_{k}"), minimum, tier, support, cap, entity, policy)))
    return _columns(rows.select("user_id", "film_id", *RANKS, F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x")))


def _dealt(rows: DataFrame, tasks: int | None) -> DataFrame:
    """A row a user, back with the user's candidates after Python: Spark doesn't know that it never left."""
    return rows if tasks is None else rows.repartition(tasks, "user_id")


def world_cinema(rows: DataFrame, policy: Policy = DEFAULT, tasks: int | None = None) -> DataFrame:
    """The world cinema shelf of ``candidates_with_facts``: a user's eligible films in one row, of which those under the cap per country stay. tasks: how many candidates are dealt to, for shelves that go on by user."""
    film = F.struct("rrf_rank", "film_id", "svd_rank", "membership", "stratum", "countries")
    mine = world_eligible(rows, policy).groupBy("user_id").agg(F.array_sort(F.collect_list(film)).alias("films"), F.max("country_support").alias("country_support"))
    cap = policy.world_country_cap

    def kept(films: list) -> list:
        used: dict[int, int] = {}
        out = []
        for place, ids in enumerate(films):
            if ids and all(used.get(i, 0) >= cap for i in ids):
                continue
            if ids:
                least = min(ids, key=lambda i: (used.get(i, 0), i))
                used[least] = used.get(least, 0) + 1
            out.append(place)
        return out

    def run(batches):
        for batch in batches:
            films = batch.column("films")
            ids = pa.ListArray.from_arrays(films.offsets, films.values.field("countries")).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([kept(x) for x in ids], pa.list_(pa.int32()))], [*batch.schema.names, "kept"])

    schema = ", ".join(f"{c} {t}" for c, t in mine.dtypes) + ", kept array<int>"
    rows = mine.mapInArrow(run, schema).where(F.size("kept") >= policy.world_minimum)
    taken = F.transform("kept", lambda i: F.get("films", i).dropFields("countries"))
    rows = _dealt(rows.select("user_id", "country_support", taken.alias("films")), tasks).select("user_id", "country_support", F.posexplode("films").alias("at", "f"))
    tier = F.when(F.col("country_support").isNotNull(), "strong").otherwise("minimum")
    entry = _entry("world_cinema", F.col("at") + 1, policy.world_minimum, tier, F.coalesce("country_support", F.lit(0)), policy.world_head_cap, None, policy)
    return _columns(rows.select("user_id", "f.film_id", *(f"f.{c}" for c in RANKS), entry.alias("x")))


def near_lists(ranked: DataFrame, anchor_rows: DataFrame, vectors: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """user_id, candidates (how many have a vector), near: a row a user, an entry (anchor_id, rating, film, similarity, rrf_rank, source) for each of the user's anchors of the greatest rating.

    source is twice the svd_rank (0: none), and one more where popularity holds the film too.

    See shelves.neighbourhoods. Vectors aren't sent along with candidates: blocks of users, with their anchors' and candidates' ids,
    meet the block of items. Of more items than one block holds, rows meet their vectors instead.
    """
    items = saved(vectors.select(F.col("film_id").cast("bigint").alias("film_id"), F.col("vec").cast("array<double>").alias("vec")))
    source = (F.coalesce("svd_rank", F.lit(0)) * 2 + F.col("membership").isin("both", "popularity_only").cast("int")).cast("bigint")
    if items.count() > ITEMS:
        near = S.neighbourhoods(ranked, anchor_rows, vectors, policy).join(ranked.select("user_id", "film_id", source.alias("source")), ["user_id", "film_id"])
        rows = near.groupBy("user_id", "anchor_id", "rating").agg(F.array_sort(F.collect_list(F.struct("place", "film_id", "similarity", "rrf_rank", "source"))).alias("n"))
        lists = rows.groupBy("user_id").agg(F.collect_list(F.struct("anchor_id", "rating", F.col("n.film_id").alias("film"), F.col("n.similarity").alias("similarity"), F.col("n.rrf_rank").alias("rrf_rank"), F.col("n.source").alias("source"))).alias("near"))
        counts = ranked.join(items.select("film_id"), "film_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("candidates"))
        return lists.join(counts, "user_id").select("user_id", "candidates", "near")
    mine = anchor_rows.groupBy("user_id").agg(F.max("rating").alias("most"), F.collect_list(F.struct("film_id", "rating")).alias("a"))
    mine = mine.select("user_id", F.col("most").cast("double").alias("rating"), F.transform(F.filter("a", lambda x: x["rating"] == F.col("most")), lambda x: x["film_id"].cast("bigint")).alias("anchors"))
    # Candidates of users with an anchor only; they lie with their user already.
    own = ranked.select("user_id", "film_id", "rrf_rank", source.alias("source")).join(small(items.select("film_id")), "film_id", "left_semi").groupBy("user_id").agg(F.collect_list(F.struct("rrf_rank", "film_id", "source")).alias("c"))
    rows = saved(own.join(mine, "user_id").select(F.col("user_id").cast("bigint").alias("user_id"), "rating", "anchors", F.col("c.film_id").cast("array<bigint>").alias("film"), F.col("c.rrf_rank").cast("array<bigint>").alias("rank"), F.col("c.source").alias("source")))
    blocks = max(1, -(-rows.count() // USERS))
    packed = rows.select(F.pmod(F.xxhash64("user_id"), F.lit(blocks)).alias("block"), F.struct("*").alias("row")).groupBy("block").agg(F.collect_list("row").alias("q")).select("q")
    pairs = packed.crossJoin(items.agg(F.collect_list(F.struct("film_id", "vec")).alias("i")))

    def kept(near: np.ndarray) -> np.ndarray:
        x, y = near.shape
        if policy.anchor_neighbours is not None:
            return np.full(x, min(policy.anchor_neighbours, y))
        if policy.anchor_fraction is not None:
            return np.full(x, min(y, max(policy.anchor_minimum, int(np.ceil(y * policy.anchor_fraction)))))
        return (near > 0).sum(axis=1)

    def of_user(rating, anchors, film, rank, source, ids, vec) -> list[tuple]:
        a, c = np.searchsorted(ids, anchors), np.searchsorted(ids, film)
        near = np.round(vec[a] @ vec[c].T, 6)
        out = []
        for anchor, row, k in zip(anchors, near, kept(near), strict=True):
            order = np.lexsort((film, rank, -row))[:k]
            out.append({"anchor_id": int(anchor), "rating": rating, "film": film[order], "similarity": row[order], "rrf_rank": rank[order], "source": source[order]})
        return out

    struct = pa.struct([("anchor_id", pa.int64()), ("rating", pa.float64()), ("film", pa.list_(pa.int64())), ("similarity", pa.list_(pa.float64())), ("rrf_rank", pa.list_(pa.int64())), ("source", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q, items = batch.column("q")[i].values, batch.column("i")[i].values
                ids = items.field("film_id").to_numpy()
                order = np.argsort(ids, kind="stable")
                ids, vec = ids[order], np.asarray(items.field("vec").flatten()).reshape(len(ids), -1)[order]
                lists = [[x.to_numpy() if (x := a.values) is not None else np.zeros(0, np.int64) for a in q.field(c)] for c in ("anchors", "film", "rank", "source")]
                near = [of_user(r, *own, ids, vec) for r, *own in zip(q.field("rating").to_pylist(), *lists, strict=True)]
                counts = pa.array([len(f) for f in lists[1]], pa.int64())
                yield pa.RecordBatch.from_arrays([q.field("user_id"), counts, pa.array(near, pa.list_(struct))], ["user_id", "candidates", "near"])

    entry = "struct<anchor_id: bigint, rating: double, film: array<bigint>, similarity: array<double>, rrf_rank: array<bigint>, source: array<bigint>>"
    return pairs.mapInArrow(run, f"user_id bigint, candidates bigint, near array<{entry}>")


def anchor_statistics(near: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """user_id, anchor_id, rating, mean, size, overlap, film, similarity, rrf_rank, source: each user's best anchor, see shelves.chosen_anchors."""

    def told(x: Column) -> Column:
        first, ranks = F.slice(x["similarity"], 1, 20), F.slice(x["rrf_rank"], 1, 20)
        inside = F.size(F.filter(ranks, lambda r: r <= 20))
        mean = F.round(F.aggregate(first, F.lit(0.0), lambda s, v: s + v) / F.size(first), 6)
        return F.struct((-x["rating"]).alias("r"), (-mean).alias("m"), (-F.size(x["film"])).alias("s"), (inside / (F.size(first) + 20 - inside)).alias("overlap"), x["anchor_id"].alias("anchor_id"), x["film"].alias("film"), x["similarity"].alias("similarity"), x["rrf_rank"].alias("rrf_rank"), x["source"].alias("source"))

    enough = F.filter("near", lambda x: F.size(x["film"]) >= policy.anchor_minimum)
    rows = near.select("user_id", F.array_min(F.transform(enough, told)).alias("c")).where("c IS NOT NULL")
    return rows.select("user_id", "c.anchor_id", (-F.col("c.r")).alias("rating"), (-F.col("c.m")).alias("mean"), (-F.col("c.s")).alias("size"), "c.overlap", "c.film", "c.similarity", "c.rrf_rank", "c.source")


def because_you_liked(near: DataFrame, strata: DataFrame, titles: DataFrame, policy: Policy = DEFAULT, tasks: int | None = None) -> DataFrame:
    """The neighbourhood of the best anchor of ``near_lists``. strata and titles of films are few enough to be sent."""
    best = _dealt(anchor_statistics(near, policy).select("user_id", "anchor_id", "rating", "film", "rrf_rank", "source"), tasks).join(titles.select(F.col("film_id").alias("anchor_id"), "title"), "anchor_id", "left")
    rows = best.select("user_id", "rating", "title", F.posexplode(F.arrays_zip("film", "rrf_rank", "source")).alias("at", "f")).select("user_id", "rating", "title", "at", F.col("f.film").alias("film_id"), F.col("f.rrf_rank").alias("rrf_rank"), F.col("f.source").alias("source")).join(strata.select("film_id", "stratum"), "film_id")
    tier = F.when(F.col("rating") >= R.ANCHOR, "strong").otherwise("minimum")
    entry = _entry("because_you_liked", F.col("at") + 1, policy.anchor_minimum, tier, 1, None, F.col("title"), policy)
    by_svd, by_popularity = F.col("source") >= 2, F.col("source") % 2 == 1
    ranks = [F.when(by_svd, F.floor(F.col("source") / 2)).alias("svd_rank"), R.membership(by_svd, by_popularity).alias("membership")]
    return _columns(rows.select("user_id", "film_id", "rrf_rank", "stratum", *ranks, entry.alias("x")))
