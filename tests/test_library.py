import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marquee.functions import cleaning, ratings
from marquee.operators import allocation, evaluation, identity, quality, ranking, vectors
from marquee.plans import catalog


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))


SOME = ["unwatched_popular", "popularity_strata", "exact_top_k", "entity_preferences", "qualified_preferences", "leave_two_out", "user_folds", "ranking_metrics", "metric_views", "clean_lists", "first_row_wins", "title_resolution", "pending_promotion", "donor_join", "sessions", "stream_upsert", "stream_pending_arrivals", "stream_late_upserts", "rated_snapshot", "imported_films", "popularity_medians", "portfolio_invariants", "catalog_coverage"]


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, sf, name):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    df = catalog.QUERIES[name](spark, sf)
    want = c.execute(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(d[0] for d in want.description)
    columns = [d[0] for d in want.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rating_bands(spark):
    rows = spark.createDataFrame([(0.5,), (3.0,), (3.5,), (4.0,), (4.5,), (5.0,), (5.5,), (3.3,), (None,)], "r double")
    got = rows.select(ratings.bucket(F.col("r")), ratings.relevance(F.col("r"))).collect()
    assert [x[0] for x in got] == [0, 5, 6, 7, 8, 9, None, None, None]
    assert [x[1] for x in got][:6] == [0, 0, 1, 2, 3, 3]


def test_strata_round_up(spark):
    popular = spark.createDataFrame([(i, i) for i in range(1, 12)], "film_id long, popularity_rank long")
    got = {r.film_id: r.stratum for r in ranking.with_strata(popular).collect()}
    assert [got[i] for i in (1, 2, 3, 6, 7, 11)] == ["HEAD", "HEAD", "MID", "MID", "TAIL", "TAIL"]


def test_popularity_keeps_films_without_positives_and_breaks_ties_by_id(spark):
    logs = spark.createDataFrame([(1, 7, 4.0), (2, 5, 4.5), (1, 9, 1.0), (3, 9, None)], "user_id long, film_id long, rating double")
    assert [(r.film_id, r.popularity_rank) for r in ranking.popularity(logs).orderBy("popularity_rank").collect()] == [(5, 1), (7, 2), (9, 3)]


def test_rank_fusion_ties_and_missing_sources(spark):
    rows = spark.createDataFrame([(1, 2, 1, None), (1, 3, None, 1), (1, 4, 2, 2)], "user_id long, film_id long, svd_rank long, popularity_rank long")
    assert [r.film_id for r in ranking.fused(rows).orderBy("rrf_rank").collect()] == [4, 2, 3]


def test_svd_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a = np.where(rng.random((30, 12)) < 0.5, rng.integers(1, 11, (30, 12)) / 2, 0)
    logs = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(30) for j in range(12) if a[i, j]], "user_id long, film_id long, rating double")
    got = {r.film_id: r.vec for r in vectors.truncated_svd(logs, 4).collect()}
    v = np.linalg.svd(a)[2][:4].T
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    mine = np.array([got[j] for j in range(12)])
    assert np.allclose(mine @ mine.T, v @ v.T, atol=1e-6)


def test_target_rank_ties(spark):
    scores = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (1, 3, 0.9), (1, 4, float("nan"))], "user_id long, film_id long, score double")
    targets = spark.createDataFrame([(1, 2), (1, 9)], "user_id long, film_id long")
    assert {r.film_id: r["rank"] for r in evaluation.target_ranks(scores, targets).collect()} == {2: 3, 9: None}
    assert {r.film_id: r["rank"] for r in evaluation.target_ranks(scores, targets, True).collect()}[2] == 3


def test_target_rank_crosses_no_users_with_films(spark, sf):
    df = catalog.QUERIES["target_rank"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    test_against_sql(spark, sf, "target_rank")


def test_sampler_keeps_positives_and_cap(spark):
    rows = spark.createDataFrame([(1, i, ("both", "svd_only", "popularity_only")[i % 3], i) for i in range(300)], "user_id long, film_id long, membership string, popularity_rank long")
    labels = spark.createDataFrame([(1, 5, 3), (1, 250, 1)], "user_id long, film_id long, label int")
    got = evaluation.sampled_groups(rows, labels, 64).collect()
    assert len(got) == 64 and {r.film_id for r in got if r.taken_by == "positive"} == {5, 250}
    assert len({r.film_id for r in got}) == 64


def test_conflicts_fail(spark):
    rows = spark.createDataFrame([(1, 1, 2.0), (1, 1, 3.0)], "user_id long, film_id long, rating double")
    with pytest.raises(quality.DataError):
        quality.conflict_checked(rows, ["user_id", "film_id"], "rating")


def test_reconcile(spark):
    profile = spark.createDataFrame([("a", 1, s, r, q) for q, (s, r) in enumerate([("x", 4.0), ("x", 5.0), ("y", None), ("z", 1.0), ("w", 2.0), ("v", 3.0)])], "username string, user_id long, slug string, rating double, seq int")
    films = spark.createDataFrame([("x", 1), ("y", 2)], "slug string, film_id long")
    logs = spark.createDataFrame([(1, 1, 4.0), (1, 2, None)], "user_id long, film_id long, rating double")
    queue = spark.createDataFrame([("z", "FAILED"), ("w", "PENDING")], "slug string, status string")
    pending = spark.createDataFrame([("a", "w", 3.0)], "username string, slug string, rating double")
    got = {r.slug: r.action for r in identity.reconcile(profile, films, logs, queue, pending).collect()}
    assert got == {"x": "update", "y": "keep", "z": "terminal", "w": "refresh", "v": "enqueue"}


def test_title_key_and_lists(spark):
    df = spark.createDataFrame([("  Große \t Fuge", "['a', ' b ', '', 'a']"), (None, "broken")], "t string, l string")
    got = df.select(cleaning.title_key(F.col("t")), cleaning.parse_list(F.col("l"))).collect()
    assert got[0][0] == "grosse fuge" and got[0][1] == ["a", "b", "a"] and got[1][1] == []


def test_empty_inputs(spark):
    logs = spark.createDataFrame([], "user_id long, film_id long, rating double")
    assert ranking.popularity(logs).count() == 0
    assert evaluation.holdout(logs).count() == 0


def test_portfolio_of_a_user_without_top_picks_is_empty(spark):
    shelf = spark.createDataFrame([(1, "hidden_gems", 1, 5, "discovery", "strong", 1, 1, 20, False, None, None)], "user_id long, key string, pos int, film_id long, role string, tier string, support long, minimum int, maximum int, head boolean, head_cap int, entity string")
    users = spark.createDataFrame([(1, "established")], "user_id long, depth_band string")
    entity = spark.createDataFrame([(5, "director", 1, "x")], "film_id long, family string, entity_id long, name string")
    assert allocation.allocate(shelf, users, entity).count() == 0
