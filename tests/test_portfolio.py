"""The portfolio's cases, caps per country, category values against plain ones, and the ranker's formulas."""

import math
import random
from collections import Counter
from dataclasses import replace
from statistics import fmean, median, pstdev

import pytest

from marquee.operators import allocation, shelves
from marquee.operators import category_report as C
from marquee.operators import ranker_features as X
from marquee.operators import variants as V
from marquee.operators.preferences import DEFAULT, FIRST

SHELF = "user_id long, key string, pos int, film_id long, role string, tier string, support long, minimum int, maximum int, head boolean, head_cap int, entity string"
ENTITY = "film_id long, family string, entity_id long, name string"


def _shelf(key, films, role, tier="strong", support=20, minimum=1, head=(), cap=None, user=1):
    return [(user, key, i + 1, f, role, tier, support, minimum, 20, f in head, cap, None) for i, f in enumerate(films)]


def _allocated(spark, rows, entities=(), policy=DEFAULT, band="established"):
    users = spark.createDataFrame([(u, band) for u in {r[0] for r in rows}], "user_id long, depth_band string")
    got = allocation.allocate(spark.createDataFrame(rows, SHELF), users, spark.createDataFrame(list(entities), ENTITY), policy).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.shelf, r.pos)):
        out.setdefault(r.key, []).append(r.film_id)
    return out


def test_head_films_are_capped_and_the_rest_is_filled(spark):
    decades = [(f, "decade", 2000, "2000s") for f in range(1, 61)]
    rows = _shelf("top_picks", range(41, 61), "general") + _shelf("classic_cinema", range(1, 41), "cultural", support=40, minimum=8, head=range(1, 21), cap=12)
    got = _allocated(spark, rows, decades)
    assert got["classic_cinema"] == [*range(1, 13), *range(21, 29)]


def test_ten_are_reserved_two_appearances_allowed_and_soft_caps_relaxed(spark):
    entities = [x for f in range(1, 31) for x in ((f, "director", f, f"D{f}"), (f, "genre", 1, "Drama"), (f, "decade", 1990, "1990s"))]
    rows = _shelf("top_picks", range(1, 31), "general", support=30) + _shelf("favorite_genre", range(1, 31), "personalized", support=10, minimum=20)
    got = _allocated(spark, rows, entities)["favorite_genre"]
    assert not set(range(1, 11)) & set(got) and set(range(11, 21)) <= set(got) and len(got) == 20


def test_a_shelf_under_its_minimum_is_left_out(spark):
    rows = _shelf("top_picks", range(1, 25), "general", support=24) + _shelf("hidden_gems", (21, 22, 23), "discovery", "minimum", 3, 4)
    assert list(_allocated(spark, rows)) == ["top_picks"]


def test_established_users_get_personalized_first_and_no_weak_overlap(spark):
    rows = _shelf("top_picks", range(1, 61), "general", support=60) + _shelf("brazilian_cinema", range(1, 21), "cultural", "minimum", 20, 8) + _shelf("favorite_genre", range(21, 41), "personalized", support=8, minimum=12)
    policy = replace(DEFAULT, maximum_categories=2)
    first = _allocated(spark, rows, policy=policy)
    assert list(first) == ["top_picks", "favorite_genre"] and _allocated(spark, rows, policy=policy) == first
    assert list(_allocated(spark, rows)) == ["top_picks", "favorite_genre"]  # room is left: the overlap decides


def test_directors_are_capped(spark):
    entities = [(f, "director", 1 + (f > 6), "d") for f in range(1, 13)]
    rows = _shelf("top_picks", range(101, 121), "general") + _shelf("hidden_gems", range(1, 13), "discovery", minimum=4)
    assert _allocated(spark, rows, entities)["hidden_gems"] == [1, 2, 3, 7, 8, 9]


def test_the_first_policy_differs_where_it_should():
    assert (DEFAULT.anchor_neighbours, DEFAULT.classic_head_cap, DEFAULT.world_head_cap, DEFAULT.outside_no_hidden, DEFAULT.outside_no_head, DEFAULT.outside_head_cap, DEFAULT.outside_svd_rank) == (100, 12, 12, True, False, 4, 750)
    assert (FIRST.anchor_neighbours, FIRST.classic_head_cap, FIRST.world_head_cap, FIRST.outside_no_hidden, FIRST.outside_no_head, FIRST.outside_head_cap, FIRST.outside_primary) == (None, None, None, False, True, 0, False)


def test_outside_the_usual_begins_beyond_the_hidden_gems(spark):
    ranked = spark.createDataFrame([(1, f, 1.0 / f, f, None, 1.0, f, "svd_only", "TAIL") for f in range(1, 1001)], "user_id long, film_id long, svd_score double, svd_rank long, popularity_rank long, rrf_score double, rrf_rank long, membership string, stratum string")
    users = spark.createDataFrame([(1, 10)], "user_id long, indexed_positive long")
    entity = spark.createDataFrame([x for f in range(1, 1001) for x in ((f, "genre", 2, "Horror"), (f, "country", 11, "Japan"))], ENTITY)
    prefs = spark.createDataFrame([(1, "genre", 1, 1.0, 10, 4.5), (1, "country", 10, 1.0, 10, 4.5)], "user_id long, family string, entity_id long, affinity double, support long, entity_mean double")
    hidden = [r.film_id for r in shelves.hidden_gems(ranked, users).orderBy("pos").collect()]
    outside = [r.film_id for r in shelves.outside_usual(ranked, users, entity, prefs).orderBy("pos").collect()]
    assert hidden[:20] == list(range(1, 21)) and outside[:20] == list(range(251, 271)) and not set(hidden) & set(outside)


def test_countries_are_capped_in_rank_order(spark):
    r = random.Random(8)
    rows = [(u, f, f, sorted(r.sample(range(5), r.randint(1, 3)))) for u in (1, 2) for f in range(1, 61)]
    want = []
    for u in (1, 2):
        used = Counter()
        for _, f, _, ids in sorted(x for x in rows if x[0] == u):
            if all(used[i] >= 4 for i in ids):
                continue
            used[min(ids, key=lambda i: (used[i], i))] += 1
            want.append((u, f))
    got = shelves.capped_countries(spark.createDataFrame(rows, "user_id long, film_id long, rrf_rank long, countries array<long>"), 4).collect()
    assert sorted(map(tuple, got)) == want


def test_neighbourhoods_equal_plain_ones(spark):
    r = random.Random(6)
    vec = {f: [r.choice([-1.0, 0.0, 1.0, r.random()]) for _ in range(4)] for f in range(1, 31)}
    ranked = [(u, f, i + 1, "MID") for u in (1, 2) for i, f in enumerate(r.sample(range(1, 31), 25))]
    anchors = [(1, 3, 5.0), (1, 4, 5.0), (1, 5, 4.5), (2, 6, 4.0), (3, 7, 5.0)]
    tables = spark.createDataFrame(ranked, "user_id long, film_id long, rrf_rank long, stratum string"), spark.createDataFrame(anchors, "user_id long, film_id long, rating double"), spark.createDataFrame(list(vec.items()), "film_id long, vec array<double>")
    for policy in (replace(DEFAULT, anchor_neighbours=7), replace(DEFAULT, anchor_neighbours=None, anchor_fraction=0.5), replace(DEFAULT, anchor_neighbours=None)):
        want = set()
        for u, anchor, rating in anchors:
            if rating < max(x[2] for x in anchors if x[0] == u):
                continue
            near = sorted((-round(sum(a * b for a, b in zip(vec[anchor], vec[f], strict=True)), 6), rank, f) for v, f, rank, _ in ranked if v == u)
            keep = 7 if policy.anchor_neighbours else max(8, math.ceil(len(near) * 0.5)) if policy.anchor_fraction else sum(s < 0 for s, _, _ in near)
            want |= {(u, anchor, f, i + 1) for i, (_, _, f) in enumerate(near[:keep])}
        assert {(x.user_id, x.anchor_id, x.film_id, x.place) for x in shelves.neighbourhoods(*tables, policy).collect()} == want


def test_category_values_equal_plain_ones(spark):
    r = random.Random(2)
    rows, entities = [], [(f, fam, r.randint(1, 3), "x") for f in range(40) for fam in C.CONCENTRATED if r.random() < 0.8]
    for u in range(25):
        for place, key in enumerate(r.sample(["top_picks", "hidden_gems", "classic_cinema"], r.randint(1, 3))):
            rows += [(u, key, place + 1, f, place * 2) for f in r.sample(range(40), r.randint(1, 9))]
    table = spark.createDataFrame(rows, "user_id long, key string, shelf int, film_id long, support long")
    plain = {}

    def put(section, name, value):
        plain.setdefault((section, name), []).append(value)

    for u in range(25):
        mine = [x for x in rows if x[0] == u]
        films = Counter(x[3] for x in mine)
        for name, v in (("categories", len({x[1] for x in mine})), ("films", len(films)), ("duplicate_rate", 1 - len(films) / len(mine)), ("appearances", max(films.values()))):
            put("portfolio", name, v)
        for key in {x[1] for x in mine}:
            own = [x for x in mine if x[1] == key]
            for name, v in (("row_size", len(own)), ("position", own[0][2]), ("evidence_support", own[0][4])):
                put(key, name, v)
            for fam in C.CONCENTRATED:
                put(key, f"concentration_{fam}", max(Counter(e[2] for x in own for e in entities if e[:2] == (x[3], fam)).values(), default=0) / len(own))
    got = {(x.section, x.name): x for x in C.summary(C.user_values(table).unionByName(C.row_values(table, spark.createDataFrame(entities, ENTITY)))).collect()}
    assert got.keys() == plain.keys()
    for k, v in plain.items():
        x = got[k]
        assert x["count"] == len(v) and (x.least, x.mean, x["median"], x.most, x.deviation) == pytest.approx((min(v), fmean(v), median(v), max(v), pstdev(v)), abs=2e-6)
    near = {(x.section, x.name): x for x in C.summary(C.user_values(table), sketch=True).collect()}
    assert all(near[k]["count"] == len(v) and abs(near[k].mean - fmean(v)) < 2e-6 and near[k]["median"] in v for k, v in plain.items() if k[0] == "portfolio")


def test_feature_names_and_groups():
    assert len(X.NAMES) == len(set(X.NAMES)) == 115
    assert [len(g) for g in (X.SOURCE, X.USER, X.FILM, X.CATALOG, X.AFFINITY, X.PREFERENCE)] == [16, 15, 10, 14, 48, 12]
    assert "svd_profile_available" in X.GROUPS["full_without_svd"] and "svd_score" not in X.GROUPS["full_without_svd"]
    assert not any("popularity" in n or n.startswith("is_") for n in X.GROUPS["full_without_popularity"])


def test_ranker_formulas_on_a_small_fold(spark):
    films = spark.createDataFrame([(10, 2000, 100), (20, 2010, 110), (30, 2020, 120), (40, None, None)], "film_id long, year long, runtime long")
    logs = spark.createDataFrame([(1, 10, 5.0), (1, 20, 2.0)], "user_id long, film_id long, rating double")
    entity = spark.createDataFrame([(f, fam, e, "x") for fam in X.SMOOTHING for f, e in ((10, 0), (20, 1), (30, 0))], ENTITY)
    candidates = spark.createDataFrame([(1, 30, 0.5, 1, 2), (1, 40, None, None, 3)], "user_id long, film_id long, svd_score double, svd_rank long, popularity_rank long")
    profiles = spark.createDataFrame([(1, [1.0])], "user_id long, vec array<double>")
    got = {r.film_id: r.asDict() for r in X.matrix(candidates, logs, films, entity, profiles, 10).collect()}
    a = got[30]
    assert list(a) == ["user_id", "film_id", *X.NAMES]
    for family, smooth in X.SMOOTHING.items():
        want = round((5.0 - 3.0) / (1 + smooth), 6)
        assert (a[f"{family}_affinity_mean"], a[f"{family}_affinity_max"], a[f"{family}_affinity_min"]) == (want,) * 3
        assert (a[f"{family}_support_sum"], a[f"{family}_matched_count"], a[f"{family}_matched_fraction"]) == (1.0, 1.0, 1.0)
        assert all(got[40][f"{family}_{s}"] == 0.0 for s in X.STATISTICS)
    assert (a["positive_year_mean"], a["year_distance"], a["year_z_distance"]) == (2000.0, 20.0, 20.0)
    assert (a["rated_count"], a["mean_rating"], a["rating_variance"], a["positive_count"], a["negative_count"], a["rating_range"]) == (2.0, 3.5, 2.25, 1.0, 1.0, 3.0)
    assert a["watched_count"] is None and a["unrated_watch_fraction"] is None
    assert (a["svd_reciprocal_rank"], a["svd_rank_fraction"], a["source_rank_gap"], a["retrieved_by_both"]) == (1.0, 0.1, 0.1, 1.0)
    b = got[40]
    assert b["svd_rank"] is None and b["source_rank_gap"] is None and b["year_missing"] == b["runtime_missing"] == 1.0 and b["year_distance"] is None and b["cohort_rating_count"] == 0.0
    assert X.group(X.matrix(candidates, logs, films, entity, profiles, 10), "source_only").columns == ["user_id", "film_id", *X.SOURCE]


def test_variants_equal_the_shelves_of_each_policy(spark):
    r = random.Random(12)
    ranked = []
    for u in range(6):
        films = r.sample(range(120), 80)
        for i, f in enumerate(films):
            ranked.append((u, f, r.choice([-0.1, 0.2, 0.4]), i + 1 if r.random() < 0.8 else None, i + 1, 0.0, i + 1, r.choice(["svd_only", "both"]), r.choice(["HEAD", "MID", "TAIL"])))
    tables = {
        "ranked": spark.createDataFrame(ranked, "user_id long, film_id long, svd_score double, svd_rank long, popularity_rank long, rrf_score double, rrf_rank long, membership string, stratum string"),
        "users": spark.createDataFrame([(u, u) for u in range(6)], "user_id long, indexed_positive long"),
        "entity": spark.createDataFrame([(f, fam, f % 4, "x") for f in range(120) for fam in ("genre", "country")], ENTITY),
        "prefs": spark.createDataFrame([(u, fam, u % 4, 1.0, 9, 4.0) for u in range(6) for fam in ("genre", "country")], "user_id long, family string, entity_id long, affinity double, support long, entity_mean double"),
        "films": spark.createDataFrame([(f, 1950 + f % 40, f"t{f}") for f in range(120)], "film_id long, year long, title string"),
        "anchors": spark.createDataFrame([(u, f, 5.0) for u in range(6) for f in (u, u + 50)], "user_id long, film_id long, rating double"),
        "vectors": spark.createDataFrame([(f, [r.random() - 0.5 for _ in range(3)]) for f in range(120)], "film_id long, vec array<double>"),
    }
    base = replace(DEFAULT, hidden_minimum=3, classic_minimum=3, outside_minimum=3, anchor_minimum=3)
    policies = {"default": base, "first": replace(base, anchor_neighbours=None, outside_no_head=True, outside_no_hidden=False, outside_primary=False), "tight": replace(base, hidden_mid_rank=20, hidden_tail_rank=10, classic_year=1959, outside_svd_rank=30, outside_rrf_rank=40, outside_primary_svd_rank=25, anchor_neighbours=5), "share": replace(base, anchor_neighbours=None, anchor_fraction=0.2, hidden_positives=1)}
    table = V.policy_table(spark, policies)
    near = shelves.neighbourhoods(tables["ranked"], tables["anchors"], tables["vectors"], replace(base, anchor_neighbours=10**6)).crossJoin(spark.createDataFrame([(80,)], "candidates long"))
    made = V.hidden_gems(tables["ranked"], tables["users"], table).unionByName(V.classic_cinema(tables["ranked"], tables["films"], table)).unionByName(V.outside_usual(tables["ranked"], tables["users"], tables["entity"], tables["prefs"], table, base)).unionByName(V.because_you_liked(near, table))
    got = {}
    for x in made.collect():
        got.setdefault((x.variant, x.key), set()).add((x.user_id, x.pos, x.film_id))
    for name, policy in policies.items():
        one = [shelves.hidden_gems(tables["ranked"], tables["users"], policy), shelves.classic_cinema(tables["ranked"], tables["films"], policy), shelves.outside_usual(tables["ranked"], tables["users"], tables["entity"], tables["prefs"], policy), shelves.because_you_liked(tables["ranked"], tables["anchors"], tables["vectors"], tables["films"], policy)]
        for key, rows in zip(("hidden_gems", "classic_cinema", "outside_usual", "because_you_liked"), one, strict=True):
            assert got.get((name, key), set()) == {(x.user_id, x.pos, x.film_id) for x in rows.collect()}, (name, key)
    assert {k for _, k in got} == {"hidden_gems", "classic_cinema", "outside_usual", "because_you_liked"}
