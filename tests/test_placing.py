"""Shelves placed in one pass against the shelves one by one, and candidates that aren't shuffled."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marquee.operators import category_report, features, placing, preferences, ranking, shelves
from marquee.operators.preferences import DEFAULT
from marquee.plans import catalog, core, training, variants
from marquee.sources.bridge import derived

POLICY = replace(DEFAULT, hidden_minimum=3, national_minimum=2, national_countries=("c1", "c2"), national_languages=("l1", "l2"), english_languages=("l0",), english_countries=("c0",), outside_minimum=2, outside_svd_rank=20, outside_rrf_rank=45, outside_primary_svd_rank=15, outside_primary_rrf_rank=40,
                 genre_minimum=3, decade_minimum=3, world_minimum=3, world_country_cap=2, directors_minimum=3, classic_minimum=3, anchor_minimum=5, anchor_neighbours=7, broad_support=2, broad_positive_fraction=0.3, broad_high=1)
assert catalog.QUERIES  # imports all queries in their order
KEYS = ["user_id", "key", "pos", "film_id", "role", "tier", "support", "minimum", "maximum", "head", "head_cap", "entity"]


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(5)
    films, users = range(1, 71), range(1, 25)
    logs = spark.createDataFrame([(u, f, r.choice([None, 1.0, 2.5, 3.0, 4.0, 4.5, 5.0])) for u in users for f in r.sample(films, r.randint(4, 30))], "user_id long, film_id long, rating double")
    entity = [(f, family, e, f"{family[0]}{e}") for f in films for family, n, most in (("director", 6, 2), ("genre", 3, 1), ("country", 4, 2), ("language", 3, 2), ("decade", 3, 1)) for e in r.sample(range(n), r.randint(1, most))]
    vec = [(f, [r.choice([-1.0, 0.0, 1.0, r.random()]) for _ in range(4)]) for f in films if f % 5]
    names = spark.createDataFrame([(f, f"t{f}", r.choice([1950, 1990, None])) for f in films], "film_id long, title string, year long")
    return logs, spark.createDataFrame(entity, "film_id long, family string, entity_id long, name string"), names, spark.createDataFrame(vec, "film_id long, vec array<double>")


def test_shelves_in_one_pass_equal_those_one_by_one(spark, tables):
    logs, entity, films, items = tables
    popular = ranking.popularity(logs)
    strata = ranking.with_strata(popular).select("film_id", "stratum")
    lists, places = core.sources(logs, items, popular, 25)
    ranked = ranking.candidates_by_user(lists, places, 25).join(F.broadcast(strata), "film_id")
    old = ranking.candidates(lists, places, 25).join(strata, "film_id")
    assert sorted(map(tuple, ranked.select(sorted(old.columns)).collect()), key=str) == sorted(map(tuple, old.select(sorted(old.columns)).collect()), key=str)
    users, prefs, anchors = preferences.profiles(logs, items), preferences.entity_preferences(logs, entity, POLICY), preferences.anchors(logs, items)
    want = shelves.all_shelves(old, users, prefs, anchors, entity, films, items, POLICY).select(KEYS).collect()
    keys = set(shelves.ROLES) - {"because_you_liked", "world_cinema"}
    facts, taste = placing.film_facts(strata, films, entity, POLICY), placing.tastes(prefs, POLICY)
    rows = placing.candidates_with_facts(ranked, F.broadcast(facts), users, taste, set(shelves.ROLES), POLICY)
    near = placing.near_lists(ranked, anchors, items, POLICY)
    got = placing.placed(rows, keys, POLICY).unionByName(placing.world_cinema(rows, POLICY)).unionByName(placing.because_you_liked(near, strata, films, POLICY)).select(KEYS).collect()
    assert {r.key for r in want} == set(shelves.ROLES)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_many_items_give_the_same_neighbours(spark, tables, monkeypatch):
    logs, _, _, items = tables
    popular = ranking.popularity(logs)
    ranked = ranking.candidates(*core.sources(logs, items, popular, 25), 25).join(ranking.with_strata(popular).select("film_id", "stratum"), "film_id")
    found = []
    for most in (16384, 10):
        monkeypatch.setattr(placing, "ITEMS", most)
        rows = placing.near_lists(ranked, preferences.anchors(logs, items), items, POLICY).select("user_id", "candidates", F.explode("near").alias("n")).select("user_id", "candidates", "n.*").collect()
        found.append(sorted(map(tuple, rows)))
    assert found[0] and found[0] == found[1]


def test_what_goes_by_user_moves_no_candidate(spark, sf):
    p = core.parts(spark, sf, core.saved(derived(spark, sf, "logs")))
    rows = p["ranked"].withColumn("n", F.count("*").over(Window.partitionBy("user_id").orderBy("rrf_rank"))).groupBy("user_id").agg(F.max("n"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and plan.count("Exchange hashpartitioning") == 1


def test_shelves_lie_with_their_user(spark, sf):
    """What reports and the portfolio group by user isn't shuffled again."""
    p = core.parts(spark, sf, core.saved(derived(spark, sf, "logs")))
    rows = core.proposed(p, set(shelves.ROLES)).select("user_id", "key", "film_id")
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges(rows.groupBy("user_id", "film_id").agg(F.count("*")).groupBy("user_id").agg(F.count("*"))) <= exchanges(rows)


def test_the_grid_meets_targets_in_the_users_row(spark):
    r = random.Random(3)
    rows, want = [], {}
    for u in range(1, 6):
        films = r.sample(range(1, 60), 20)
        svd, popular = ([r.randint(0, 3) for _ in films] for _ in range(2))
        wanted = [films[3], films[7], 99]
        rows.append((u, wanted, films, svd, popular))
        for w, k in ((0.2, 20), (0.5, 60)):
            score = {f: round((w / (k + a) if a else 0.0) + ((1 - w) / (k + b) if b else 0.0), 12) for f, a, b in zip(films, svd, popular, strict=True)}
            for t in wanted:
                want[u, t, w, k] = 1 + sum((-score[f], f) < (-score[t], t) for f in films) if t in score else None
    lists = spark.createDataFrame([*rows, (9, [5], [], [], [])], "user_id long, wanted array<long>, film array<long>, svd array<long>, popular array<long>")
    got = features.grid_of_lists(lists, (0.2, 0.5), (20, 60)).select("user_id", "film_id", F.explode("cells").alias("c")).select("user_id", "film_id", "c.*").collect()
    found = {(r.user_id, r.film_id, r.svd_weight, r.k): r.rank for r in got}
    assert {k: found[k] for k in want} == want and found[9, 5, 0.5, 60] is None
    plan = features.grid_of_lists(lists)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_coverage_is_of_all_films(spark):
    row = (1, "top_picks", None, 5, 0, 1, 1, "both", "HEAD")
    rows = spark.createDataFrame([row, (1, "top_picks", None, 6, 0, 2, 2, "both", "MID")], "user_id long, key string, shelf int, film_id long, support long, svd_rank long, rrf_rank long, membership string, stratum string")
    good = spark.createDataFrame([], "user_id long, family string, entity_id long, support long, entity_mean double, high long, positive_fraction double, affinity double, place int, tier string")
    anchors = spark.createDataFrame([], "user_id long, rating double, size int, overlap double, mean double")
    parts = {"users": spark.createDataFrame([(1,), (2,)], "user_id long"), "good": good, "anchors": anchors, "film_entity": spark.createDataFrame([(5, "genre", 1, "g")], "film_id long, family string, entity_id long, name string"), "catalog": spark.range(1, 11).withColumnRenamed("id", "film_id")}
    got = {(r.section, r.name): r.share for r in category_report.evaluate(rows, parts, POLICY, world=False).collect()}
    assert got["top_picks", "coverage"] == 0.2 and got["top_picks", "activation"] == 0.5


def test_candidates_meet_model_films_where_they_are(spark):
    rows = [(1, 5, 1, None), (1, 6, 2, 1), (2, 7, 1, None), (2, 8, None, 3)]
    candidates = spark.createDataFrame(rows, "user_id long, film_id long, svd_rank long, popularity_rank long")
    context, items = spark.createDataFrame([(5,), (6,), (8,)], "film_id long"), spark.createDataFrame([(5,), (6,), (7,)], "film_id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = training._fused(candidates, context, items)
        assert sorted(r.film_id for r in out.collect()) == [5, 6, 8]
        assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_recall_places_all_shelves_at_once(spark, sf, monkeypatch):
    calls = []
    monkeypatch.setattr(training, "proposed", lambda p, keys, *a: calls.append(keys) or core.proposed(p, keys, *a))
    assert training.semantic_recall(spark, sf).columns and len(calls) == 1 and "brazilian_cinema" in calls[0]


def test_variants_send_no_vectors_with_candidates(spark, sf, monkeypatch):
    def fail(*_):
        raise AssertionError("vectors with candidates")

    monkeypatch.setattr(shelves, "neighbourhoods", fail)
    assert "first_overlap" in variants.variant_table(spark, sf).columns
