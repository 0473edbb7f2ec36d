"""Queries from the interaction log to the feed."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import ratings as R
from marquee.operators import allocation, placing, preferences, ranking, shelves, vectors
from marquee.operators.preferences import Policy
from marquee.plans.registry import query
from marquee.sources.bridge import derived, kept, oracle
from marquee.sources.work import saved

DEPTH = 200
CANDIDATE = ("user_id", "film_id", "svd_score", "svd_rank", "popularity_rank", "membership", "source_count")
#: Shelf sizes for inventories of at most 400 films.
POLICY = Policy(hidden_minimum=6, hidden_mid_rank=150, hidden_tail_rank=100, national_minimum=3, national_countries=("nation_1", "nation_7"), national_languages=("america", "europe"), english_languages=("asia",), english_countries=("nation_2", "nation_3"),
                outside_minimum=6, outside_svd_rank=150, outside_rrf_rank=300, outside_primary_svd_rank=120, outside_primary_rrf_rank=250, genre_minimum=6, decade_minimum=6, world_minimum=6, world_rank=150, directors_minimum=4, anchor_neighbours=50)

ORACLE = {
    "pop": "SELECT film_id, count(*) FILTER (rating >= 3.5) AS positives, row_number() OVER (ORDER BY count(*) FILTER (rating >= 3.5) DESC, film_id) AS popularity_rank FROM logs GROUP BY film_id",
    "strata": "SELECT film_id, popularity_rank, CASE WHEN popularity_rank <= ceil(n * 0.10) THEN 'HEAD' WHEN popularity_rank <= ceil(n * 0.50) THEN 'MID' ELSE 'TAIL' END AS stratum FROM pop, (SELECT count(*) AS n FROM pop) c",
    "userdim": "SELECT user_id, d, sum(greatest(rating - 3.0, 0.0) * x) / sum(greatest(rating - 3.0, 0.0)) AS x FROM (SELECT user_id, rating, unnest(vec)::DOUBLE AS x, generate_subscripts(vec, 1) AS d FROM logs JOIN item_vectors USING (film_id) WHERE rating > 3) GROUP BY user_id, d",
    "uservec": "SELECT user_id, list(x ORDER BY d) AS uvec FROM userdim GROUP BY user_id",
    "svdall": "SELECT user_id, film_id, round(list_inner_product(uvec, vec::DOUBLE[]), 6) AS svd_score FROM uservec, item_vectors WHERE (user_id, film_id) NOT IN (SELECT (user_id, film_id) FROM logs)",
    "svd": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY svd_score DESC, film_id) AS svd_rank FROM svdall) WHERE svd_rank <= {DEPTH}",
    "popcand": f"SELECT user_id, film_id, popularity_rank FROM (SELECT u.user_id, p.film_id, popularity_rank, row_number() OVER (PARTITION BY u.user_id ORDER BY popularity_rank) AS place FROM (SELECT DISTINCT user_id FROM logs) u CROSS JOIN pop p WHERE NOT EXISTS (SELECT 1 FROM logs l WHERE l.user_id = u.user_id AND l.film_id = p.film_id)) WHERE place <= {DEPTH}",
    "cand": "SELECT coalesce(s.user_id, p.user_id) AS user_id, coalesce(s.film_id, p.film_id) AS film_id, svd_score, svd_rank, popularity_rank, CASE WHEN svd_rank IS NOT NULL AND popularity_rank IS NOT NULL THEN 'both' WHEN svd_rank IS NOT NULL THEN 'svd_only' ELSE 'popularity_only' END AS membership, CAST((svd_rank IS NOT NULL) AS INT) + CAST((popularity_rank IS NOT NULL) AS INT) AS source_count FROM svd s FULL JOIN popcand p ON s.user_id = p.user_id AND s.film_id = p.film_id",
    "rrf": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rrf_score DESC, film_id) AS rrf_rank FROM (SELECT *, round(coalesce(1.0::DOUBLE / (60 + svd_rank), 0) + coalesce(1.0::DOUBLE / (60 + popularity_rank), 0), 12) AS rrf_score FROM cand)",
    "ranked": "SELECT r.*, stratum FROM rrf r JOIN strata s USING (film_id)",
    "prof": "SELECT user_id, count(*) AS watched, count(rating) AS rated, round(avg(rating), 6) AS mean_rating, count(*) FILTER (rating >= 3.5) AS positive, count(*) FILTER (rating >= 3.5 AND v.film_id IS NOT NULL) AS indexed_positive, count(*) FILTER (rating >= 4.5) AS high, count(*) FILTER (rating <= 2.5) AS negative, CASE WHEN count(rating) < 5 THEN 'sparse' WHEN count(*) >= 2000 THEN 'deep' ELSE 'established' END AS depth_band FROM logs l LEFT JOIN item_vectors v USING (film_id) GROUP BY user_id",
    "prefs": """SELECT user_id, family, entity_id, name, support, round(em, 6) AS entity_mean, positive, high, negative, round(positive / support, 6) AS positive_fraction, round(negative / support, 6) AS negative_fraction, round(em - um, 6) AS raw_preference,
        round(support / (support + sm), 6) AS confidence, round((em - um) * (support / (support + sm)), 6) AS affinity FROM (SELECT l.user_id, family, entity_id, max(name) AS name, count(*) AS support, avg(rating) AS em, count(*) FILTER (rating >= 3.5) AS positive, count(*) FILTER (rating >= 4.5) AS high,
        count(*) FILTER (rating <= 2.5) AS negative, any_value(um) AS um, CASE WHEN family = 'director' THEN 5.0::DOUBLE ELSE 4.0::DOUBLE END AS sm FROM logs l JOIN film_entity USING (film_id) JOIN (SELECT user_id, avg(rating) AS um FROM logs GROUP BY user_id) m ON l.user_id = m.user_id WHERE rating IS NOT NULL GROUP BY l.user_id, family, entity_id)""",
    "good": """SELECT *, row_number() OVER (PARTITION BY user_id, family ORDER BY affinity DESC, support DESC, entity_mean DESC, entity_id) AS place, CASE WHEN support >= 2 * CASE WHEN family = 'director' THEN 2 ELSE 5 END THEN 'strong' ELSE 'minimum' END AS tier FROM prefs
        WHERE affinity > 0 AND CASE WHEN family = 'director' THEN support >= 2 AND positive >= 2 AND high >= 1 AND negative_fraction <= 0.25 ELSE support >= 5 AND positive_fraction >= 0.70 AND high >= 2 END""",
    "topent": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, family ORDER BY affinity DESC, support DESC, entity_mean DESC, entity_id) AS place FROM prefs WHERE affinity > 0) WHERE place <= 1",
    "anc": "SELECT user_id, film_id, rating, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, film_id) AS place FROM logs WHERE rating >= 4 AND film_id IN (SELECT film_id FROM item_vectors)",
}


def sql(text: str) -> str:
    """An oracle with the tables above and the derived ones in front."""
    import re

    need: list[str] = []

    def add(t: str) -> None:
        for n, body in ORACLE.items():
            if n not in need and re.search(rf"\b{n}\b(?!\s*\()", t) and n != t:
                add(body)
                if n not in need:
                    need.append(n)

    add(text)
    body = text.strip()
    heads = ", ".join(f"{n} AS ({ORACLE[n]})" for n in need)
    if not heads:
        return oracle(body)
    return oracle(f"WITH {heads}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {heads} {body}")


def sources(logs: DataFrame, items: DataFrame, popular: DataFrame, depth: int = DEPTH, wanted: DataFrame | None = None) -> tuple[DataFrame, ranking.Places]:
    """Lists of both sources from stored logs, a row a user (those in wanted, if given): see ranking.candidates."""
    places = ranking.watched_places(logs, popular, depth)
    places = places if wanted is None else ranking.targeted(places, wanted)
    return vectors.top_k_lists(vectors.user_profiles(logs, items), items, depth, logs, along=places.users), places


def inventory(spark: SparkSession, sf_dir: str, depth: int = DEPTH, logs: DataFrame | None = None) -> DataFrame:
    """Every user's fused candidates with strata, from all logs or those given, which are a stored table."""
    logs, items = kept(spark, sf_dir, "logs") if logs is None else logs, derived(spark, sf_dir, "item_vectors")
    popular = saved(ranking.popularity(logs))
    svd, places = sources(logs, items, popular, depth)
    within = places.films.select("film_id").unionByName(items.select("film_id"))
    strata = saved(ranking.with_strata(popular).select("film_id", "stratum").join(within, "film_id", "left_semi"))
    return ranking.candidates(svd, places, depth).join(ranking.small(strata), "film_id")


class Parts(dict):
    """The inputs of the shelves by name, each made when it is first asked for."""

    def __init__(self, make: dict[str, Callable]):
        super().__init__()
        self.make = make

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.make[name]()
        return self[name]


def parts(spark: SparkSession, sf_dir: str, logs: DataFrame | None = None) -> Parts:
    """The inputs of the shelves, from all logs or those given, which are a stored table; entities, films and strata are those of films within reach and model films.

    ranked isn't stored: its rows are made of the lists of users wherever they are read, and lie with their user.
    """
    logs = kept(spark, sf_dir, "logs") if logs is None else logs
    items = derived(spark, sf_dir, "item_vectors")
    p = Parts({
        "popular": lambda: saved(ranking.popularity(logs)),
        "sources": lambda: (lambda svd, places: (saved(svd), places))(*sources(logs, items, p["popular"])),
        "strata": lambda: ranking.small(saved(ranking.with_strata(p["popular"]).select("film_id", "stratum").join(p["within"], "film_id", "left_semi"))),
        "tasks": lambda: ranking.tasks_by_user(p["sources"][0], DEPTH),
        "ranked": lambda: ranking.candidates_by_user(*p["sources"], DEPTH, tasks=p["tasks"]).join(p["strata"], "film_id"),
        "users": lambda: preferences.profiles(logs, items),
        "every": lambda: preferences.entity_preferences(logs, derived(spark, sf_dir, "film_entity")),
        "preferences": lambda: saved(p["every"]),
        "good": lambda: saved(preferences.qualified(p["every"], POLICY)),
        "tastes": lambda: saved(placing.tastes(p["every"], POLICY)),
        "catalog": lambda: derived(spark, sf_dir, "films"),
        "near": lambda: saved(placing.near_lists(p["ranked"], p["anchor_rows"], items, POLICY)),
        "anchors": lambda: placing.anchor_statistics(p["near"], POLICY),
        "eligible": lambda: placing.world_eligible(placing.candidates_with_facts(p["ranked"], p["facts"], p["users"], p["tastes"], {"world_cinema"}, POLICY), POLICY),
        "anchor_rows": lambda: preferences.anchors(logs, items),
        "within": lambda: ranking.small(saved(p["sources"][1].films.select("film_id").unionByName(items.select("film_id")).distinct())),
        "film_entity": lambda: saved(derived(spark, sf_dir, "film_entity").join(p["within"], "film_id", "left_semi")),
        "films": lambda: saved(derived(spark, sf_dir, "films").join(p["within"], "film_id", "left_semi")),
        "facts": lambda: ranking.small(saved(placing.film_facts(p["strata"], p["films"], p["film_entity"], POLICY))),
        "titles": lambda: ranking.small(p["films"].select("film_id", "title")),
        "vectors": lambda: items,
    })
    return p


@query("unwatched_popular", sql("""SELECT user_id, film_id, title, popularity_rank, place FROM (SELECT user_id, film_id, popularity_rank, row_number() OVER (PARTITION BY user_id ORDER BY popularity_rank) AS place FROM popcand) JOIN films USING (film_id) WHERE place <= 10"""))
def unwatched_popular(spark, sf_dir):
    logs = kept(spark, sf_dir, "logs")
    places = ranking.watched_places(logs, ranking.popularity(logs), 10)
    rows = ranking.popular_lists(places, 10).select("user_id", F.posexplode(F.arrays_zip("popular", "place")).alias("at", "f"))
    rows = rows.select("user_id", F.col("f.popular").alias("film_id"), F.col("f.place").alias("popularity_rank"), (F.col("at") + 1).cast("bigint").alias("place"))
    titles = ranking.within_reach(places, derived(spark, sf_dir, "films").select("film_id", "title"))
    return rows.join(titles, "film_id").select("user_id", "film_id", "title", "popularity_rank", "place")


@query("popularity", sql("SELECT film_id, positives, popularity_rank FROM pop"))
def popularity(spark, sf_dir):
    return ranking.popularity(derived(spark, sf_dir, "logs")).select("film_id", "positives", "popularity_rank")


@query("popularity_strata", sql("SELECT film_id, popularity_rank, stratum, round(1 - percent_rank() OVER (ORDER BY popularity_rank), 6) AS percentile FROM strata"))
def popularity_strata(spark, sf_dir):
    out = ranking.with_strata(ranking.popularity(derived(spark, sf_dir, "logs")))
    return out.select("film_id", "popularity_rank", "stratum", F.round("percentile", 6).alias("percentile"))


@query("popularity_candidates", sql("SELECT * FROM popcand"))
def popularity_candidates(spark, sf_dir):
    logs = kept(spark, sf_dir, "logs")
    return ranking.popularity_candidates(logs, ranking.popularity(logs), DEPTH)


@query("popularity_candidates_renumbered", sql("SELECT user_id, film_id, row_number() OVER (PARTITION BY user_id ORDER BY popularity_rank) AS popularity_rank FROM popcand"))
def popularity_candidates_renumbered(spark, sf_dir):
    logs = kept(spark, sf_dir, "logs")
    return ranking.popularity_candidates(logs, ranking.popularity(logs), DEPTH, "post_exclusion")


@query("exact_top_k", """SELECT user_id, film_id, svd_score, svd_rank FROM (SELECT q.vec_id AS user_id, i.vec_id AS film_id, round(list_inner_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS svd_score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) DESC, i.vec_id) AS svd_rank FROM embeddings q, embeddings i WHERE q.vec_id % 50 = 0) WHERE svd_rank <= 20""")
def exact_top_k(spark, sf_dir):
    items = derived(spark, sf_dir, "item_vectors")
    return vectors.exact_top_k(items.where("film_id % 50 = 0").withColumnRenamed("film_id", "user_id"), items, 20)


@query("vector_audit", """SELECT count(*) AS rows_, count(DISTINCT vec_id) AS ids, count(DISTINCT len(embedding)) AS dimensions, count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x))) > 0) AS bad_values,
    count(*) FILTER (abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 0.0001) AS bad_norms FROM embeddings""")
def vector_audit(spark, sf_dir):
    return vectors.vector_audit(derived(spark, sf_dir, "item_vectors"))


_W = {
    "mean": ("1.0", "1.0"), "positive_mean": ("CASE WHEN rating >= 3.5 THEN 1.0 ELSE 0.0 END",) * 2, "signed": ("rating - 3.0", "abs(rating - 3.0)"),
    "centered": ("rating - um", "abs(rating - um)"), "positive_weighted": ("greatest(rating - 3.0, 0.0)",) * 2,
}


def _profile(strategy: str) -> None:
    w, s = _W[strategy]
    text = f"""WITH r AS (SELECT *, avg(rating) OVER (PARTITION BY user_id) AS um FROM logs JOIN item_vectors USING (film_id) WHERE rating IS NOT NULL),
        c AS (SELECT user_id, d, sum(({w}) * x) / sum({s}) AS x FROM (SELECT user_id, rating, um, unnest(vec)::DOUBLE AS x, generate_subscripts(vec, 1) - 1 AS d FROM r) WHERE ({w}) <> 0 GROUP BY user_id, d),
        n AS (SELECT user_id FROM c GROUP BY user_id HAVING sqrt(sum(x * x)) > 1e-12) SELECT user_id, d, round(x, 6) AS x FROM c JOIN n USING (user_id)"""

    @query(f"user_profile_{strategy}", sql(text))
    def run(spark, sf_dir):
        out = vectors.user_profiles(derived(spark, sf_dir, "logs"), derived(spark, sf_dir, "item_vectors"), strategy)
        return out.select("user_id", F.posexplode("vec").alias("d", "x")).select("user_id", F.col("d").cast("bigint").alias("d"), F.round("x", 6).alias("x"))


for _s in vectors.STRATEGIES:
    _profile(_s)


@query("svd_candidates", sql("SELECT user_id, film_id, svd_score, svd_rank FROM svd"))
def svd_candidates(spark, sf_dir):
    logs, items = kept(spark, sf_dir, "logs"), derived(spark, sf_dir, "item_vectors")
    return vectors.exact_top_k(vectors.user_profiles(logs, items), items, DEPTH, logs)


@query("candidate_union", sql("SELECT user_id, film_id, svd_score, svd_rank, popularity_rank, membership, source_count FROM cand"))
def candidate_union(spark, sf_dir):
    logs, items = kept(spark, sf_dir, "logs"), derived(spark, sf_dir, "item_vectors")
    return ranking.candidates(*sources(logs, items, ranking.popularity(logs)), DEPTH).select(*CANDIDATE)


@query("rank_fusion", sql("SELECT user_id, film_id, rrf_score, rrf_rank, stratum FROM ranked"))
def rank_fusion(spark, sf_dir):
    return inventory(spark, sf_dir).select("user_id", "film_id", "rrf_score", "rrf_rank", "stratum")


@query("rank_fusion_grid", sql("""WITH g AS (SELECT * FROM (VALUES (0.2), (0.5), (0.8)) a(w), (VALUES (20), (60)) b(k)), s AS (SELECT user_id, film_id, w::DOUBLE AS w, k, round(coalesce(w::DOUBLE / (k + svd_rank), 0) + coalesce((1 - w::DOUBLE) / (k + popularity_rank), 0), 12) AS score FROM cand, g)
    SELECT user_id, w AS svd_weight, k, film_id, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id, w, k ORDER BY score DESC, film_id) AS rn FROM s) WHERE rn <= 5"""))
def rank_fusion_grid(spark, sf_dir):
    grid = spark.createDataFrame([(w, k) for w in (0.2, 0.5, 0.8) for k in (20, 60)], "svd_weight double, k int")
    rows = candidate_union(spark, sf_dir).crossJoin(F.broadcast(grid))  # six rows
    from pyspark.sql import Window

    rows = rows.withColumn("score", ranking.rrf_score(F.col("k"), F.col("svd_weight"), 1 - F.col("svd_weight")))
    place = F.row_number().over(Window.partitionBy("user_id", "svd_weight", "k").orderBy(F.col("score").desc(), "film_id"))
    return rows.withColumn("place", place).where("place <= 5").select("user_id", "svd_weight", "k", "film_id", "place")


@query("budgeted_hybrid", sql("""WITH a AS (SELECT user_id, film_id, 0 AS o, svd_rank AS r, 'svd' AS source FROM svd WHERE svd_rank <= 60 UNION ALL SELECT user_id, film_id, 1, popularity_rank, 'popularity' FROM popcand WHERE popularity_rank <= 100),
    k AS (SELECT user_id, film_id FROM logs WHERE rating >= 4.5), m AS (SELECT user_id, film_id, min((o, r)) AS f, list_sort(list(DISTINCT source)) AS sources FROM a WHERE (user_id, film_id) NOT IN (SELECT (user_id, film_id) FROM k) GROUP BY user_id, film_id)
    SELECT user_id, film_id, place, array_to_string(sources, '+') AS sources FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f, film_id) AS place FROM m) WHERE place <= 80"""))
def budgeted_hybrid(spark, sf_dir):
    rows = candidate_union(spark, sf_dir)
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("source"), F.col(f"{s}_rank").alias("rank")) for s in ("svd", "popularity"))))
    long = rows.select("user_id", "film_id", each.alias("s")).select("user_id", "film_id", "s.*").where("rank IS NOT NULL")
    known = kept(spark, sf_dir, "logs").where("rating >= 4.5")
    return ranking.budgeted_hybrid(long, {"svd": 60, "popularity": 100}, known, 80).withColumn("sources", F.array_join("sources", "+"))


@query("user_profile_counts", sql("SELECT * FROM prof"))
def user_profile_counts(spark, sf_dir):
    return preferences.profiles(derived(spark, sf_dir, "logs"), derived(spark, sf_dir, "item_vectors"))


@query("entity_preferences", sql("SELECT * FROM prefs"))
def entity_preferences(spark, sf_dir):
    return preferences.entity_preferences(kept(spark, sf_dir, "logs"), derived(spark, sf_dir, "film_entity"))


@query("qualified_preferences", sql("SELECT user_id, family, entity_id, affinity, place, tier FROM good"))
def qualified_preferences(spark, sf_dir):
    return preferences.qualified(entity_preferences(spark, sf_dir)).select("user_id", "family", "entity_id", "affinity", "place", "tier")


@query("top_entities", sql("SELECT user_id, family, entity_id, affinity FROM topent"))
def top_entities(spark, sf_dir):
    return preferences.top_entities(entity_preferences(spark, sf_dir).where("affinity > 0"), 1).select("user_id", "family", "entity_id", "affinity")


@query("anchors", sql("SELECT user_id, film_id, rating, place FROM anc"))
def anchors(spark, sf_dir):
    return preferences.anchors(derived(spark, sf_dir, "logs"), derived(spark, sf_dir, "item_vectors"))


def _shelf_sql(rows: str, minimum: int, order: str) -> str:
    return f"SELECT user_id, film_id, pos FROM (SELECT user_id, film_id, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM ({rows})) WHERE n >= {minimum}"


_HIDDEN = "svd_score > 0 AND ((stratum = 'MID' AND svd_rank <= 150) OR (stratum = 'TAIL' AND svd_rank <= 100)) AND indexed_positive >= 3"
_BY = "rrf_rank, svd_rank, film_id"
SHELF_SQL = {
    "top_picks": _shelf_sql("SELECT * FROM ranked", 1, "rrf_rank"),
    "hidden_gems": _shelf_sql(f"SELECT r.* FROM ranked r JOIN prof USING (user_id) WHERE {_HIDDEN}", 6, "rrf_rank"),
    "national_cinema": _shelf_sql("SELECT * FROM ranked WHERE svd_score > 0 AND film_id IN (SELECT film_id FROM film_entity WHERE family = 'country' AND lower(name) IN ('nation_1', 'nation_7')) AND film_id IN (SELECT film_id FROM film_entity WHERE family = 'language' AND lower(name) IN ('america', 'europe'))", 3, _BY),
    "directors_you_love": _shelf_sql("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, entity_id ORDER BY rrf_rank) AS few FROM ranked JOIN (SELECT film_id, entity_id FROM film_entity WHERE family = 'director') USING (film_id) JOIN (SELECT user_id, entity_id FROM good WHERE family = 'director' AND place <= 15) USING (user_id, entity_id)) WHERE few <= 3", 4, "rrf_rank"),
    "favorite_genre": _shelf_sql("SELECT ranked.* FROM ranked JOIN (SELECT film_id, entity_id FROM film_entity WHERE family = 'genre') USING (film_id) JOIN (SELECT user_id, entity_id FROM good WHERE family = 'genre' AND place = 1) USING (user_id, entity_id)", 6, "rrf_rank"),
    "favorite_decade": _shelf_sql("SELECT ranked.* FROM ranked JOIN (SELECT film_id, entity_id FROM film_entity WHERE family = 'decade') USING (film_id) JOIN (SELECT user_id, entity_id FROM good WHERE family = 'decade' AND place = 1) USING (user_id, entity_id)", 6, "rrf_rank"),
    "outside_usual": _shelf_sql(f"""SELECT * FROM (SELECT r.*, count(*) FILTER (stratum <> 'HEAD' AND svd_rank <= 120 AND rrf_rank <= 250) OVER (PARTITION BY user_id) AS prim FROM ranked r JOIN prof USING (user_id) JOIN (SELECT user_id FROM topent GROUP BY user_id HAVING count(DISTINCT family) >= 2) USING (user_id)
        WHERE svd_score > 0 AND rrf_rank <= 300 AND CASE WHEN stratum = 'HEAD' THEN membership = 'svd_only' AND svd_rank <= 100 ELSE svd_rank <= 150 END AND NOT coalesce({_HIDDEN}, false)
        AND (user_id, film_id) NOT IN (SELECT (user_id, film_id) FROM topent JOIN film_entity USING (family, entity_id))) WHERE prim >= 6""", 6, "svd_rank, rrf_rank, film_id"),
    "classic_cinema": _shelf_sql("SELECT * FROM ranked WHERE svd_score > 0 AND film_id IN (SELECT film_id FROM films WHERE year <= 1969)", 8, _BY),
    "because_you_liked": """WITH a AS (SELECT user_id, film_id AS anchor_id, rating FROM (SELECT *, max(rating) OVER (PARTITION BY user_id) AS m FROM anc) WHERE rating = m),
        n AS (SELECT a.user_id, anchor_id, rating, r.film_id, rrf_rank, round(list_inner_product(x.vec::DOUBLE[], y.vec::DOUBLE[]), 6) AS sim FROM a JOIN ranked r USING (user_id) JOIN item_vectors x ON anchor_id = x.film_id JOIN item_vectors y ON r.film_id = y.film_id),
        p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, anchor_id ORDER BY sim DESC, rrf_rank, film_id) AS place FROM n) WHERE place <= 50),
        s AS (SELECT user_id, anchor_id, rating, count(*) AS size, round(avg(sim) FILTER (place <= 20), 6) AS mean, count(*) FILTER (place <= 20 AND rrf_rank <= 20) / (count(*) FILTER (place <= 20) + 20 - count(*) FILTER (place <= 20 AND rrf_rank <= 20)) AS overlap FROM p GROUP BY user_id, anchor_id, rating HAVING count(*) >= 8),
        c AS (SELECT user_id, anchor_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, mean DESC, size DESC, overlap, anchor_id) AS rn FROM s) WHERE rn = 1)
        SELECT user_id, film_id, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, rrf_rank, film_id) AS pos FROM p JOIN c USING (user_id, anchor_id)""",
}


def proposed(p: Parts, keys: set[str], policy: Policy = POLICY) -> DataFrame:
    """The shelves in keys (as in shelves.ROLES) of every user, with what placing.RANKS tells of a film; candidates stay with their user."""
    out = []
    rows = lambda some: placing.candidates_with_facts(p["ranked"], p["facts"], p["users"], p["tastes"] if some & placing.TASTED else None, some, policy)
    if some := keys - {"because_you_liked", "world_cinema"}:
        out.append(placing.placed(rows(some), some, policy))
    if "world_cinema" in keys:
        out.append(placing.world_cinema(rows({"world_cinema"}), policy, p["tasks"]))
    if "because_you_liked" in keys:
        near = p["near"] if policy == POLICY else placing.near_lists(p["ranked"], p["anchor_rows"], p["vectors"], policy)
        out.append(placing.because_you_liked(near, p["strata"], p["titles"], policy, p["tasks"]))
    return functools.reduce(DataFrame.unionByName, out)


#: Keys of queries that differ from the shelf's.
NAMED = {"national_cinema": "brazilian_cinema"}


def shelf_of(key: str, p: Parts, policy: Policy = POLICY) -> DataFrame:
    return proposed(p, {NAMED.get(key, key)}, policy)


def _shelf_query(key: str) -> None:
    @query(f"shelf_{key}", sql(SHELF_SQL[key]) if key in SHELF_SQL else None)
    def run(spark, sf_dir):
        return shelf_of(key, parts(spark, sf_dir)).select("user_id", "film_id", F.col("pos").cast("bigint").alias("pos"))


for _key in [*SHELF_SQL, "world_cinema"]:
    _shelf_query(_key)


@query("world_cinema_eligible", sql("""WITH liked AS (SELECT *, row_number() OVER (PARTITION BY user_id, family ORDER BY place) AS p FROM good WHERE (family = 'country' AND lower(name) NOT IN ('nation_2', 'nation_3')) OR (family = 'language' AND lower(name) NOT IN ('asia', 'no spoken language')))
    SELECT user_id, film_id, rrf_rank FROM ranked r WHERE film_id IN (SELECT film_id FROM film_entity WHERE family = 'country' AND lower(name) NOT IN ('nation_2', 'nation_3')) AND film_id IN (SELECT film_id FROM film_entity WHERE family = 'language' AND lower(name) NOT IN ('asia', 'no spoken language'))
    AND film_id NOT IN (SELECT film_id FROM film_entity WHERE family = 'language' AND lower(name) = 'asia')
    AND ((svd_score > 0 AND svd_rank <= 150) OR (user_id, film_id) IN (SELECT (user_id, film_id) FROM liked JOIN film_entity USING (family, entity_id) WHERE family = 'language' OR p <= 5))"""))
def world_cinema_eligible(spark, sf_dir):
    return parts(spark, sf_dir)["eligible"].select("user_id", "film_id", "rrf_rank")


def _portfolio(p: Parts) -> DataFrame:
    return allocation.allocate(proposed(p, set(shelves.ROLES)), p["users"], p["film_entity"], POLICY)


@query("portfolio")
def portfolio(spark, sf_dir):
    return _portfolio(parts(spark, sf_dir))


@query("portfolio_invariants", sql("SELECT count(*) AS users, CAST(sum(least(20, n)) AS BIGINT) AS top_slots, 0::BIGINT AS repeats, 0::BIGINT AS too_often, 0::BIGINT AS reserved_again, 0::BIGINT AS too_small, 0::BIGINT AS director_over, 0::BIGINT AS country_over, 0::BIGINT AS head_over FROM (SELECT user_id, count(*) AS n FROM ranked GROUP BY user_id)"))
def portfolio_invariants(spark, sf_dir):
    p = parts(spark, sf_dir)
    return allocation.invariants(saved(_portfolio(p)), p["strata"], p["film_entity"], POLICY)


@query("feed")
def feed(spark, sf_dir):
    p = parts(spark, sf_dir)
    return allocation.feed_documents(allocation.displayed(_portfolio(p), p["titles"]))


@query("svd_item_factors")
def svd_item_factors(spark, sf_dir):
    return vectors.truncated_svd(derived(spark, sf_dir, "logs"), 16)


@query("rating_labels", sql("""SELECT CAST(rating * 2 - 1 AS INT) AS bucket, rating, CASE WHEN rating >= 4.5 THEN 3 WHEN rating >= 4 THEN 2 WHEN rating >= 3.5 THEN 1 ELSE 0 END AS label, CASE WHEN rating >= 4.5 THEN 7 WHEN rating >= 4 THEN 3 WHEN rating >= 3.5 THEN 1 ELSE 0 END AS gain,
    (CAST(rating * 2 - 1 AS INT) + 1) / 2 AS again, count(*) AS n FROM logs WHERE rating IS NOT NULL GROUP BY rating"""))
def rating_labels(spark, sf_dir):
    rows = derived(spark, sf_dir, "logs").where("rating IS NOT NULL").groupBy("rating").agg(F.count("*").alias("n"))
    return rows.select(R.bucket(F.col("rating")).alias("bucket"), "rating", R.relevance(F.col("rating")).alias("label"), R.gain(R.relevance(F.col("rating"))).alias("gain"), R.from_bucket(R.bucket(F.col("rating"))).alias("again"), "n")
