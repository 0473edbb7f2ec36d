from pyspark.sql import functions as F

from marquee.operators import features


def test_grid_ranks_count_better_candidates(spark):
    rows = spark.createDataFrame([(1, 10, 1, None), (1, 11, 2, 1), (1, 12, None, 2), (2, 10, 1, 1)], "user_id long, film_id long, svd_rank long, popularity_rank long")
    targets = spark.createDataFrame([(1, 12), (2, 99), (3, 10)], "user_id long, film_id long")
    got = {(r.svd_weight, r.user_id): r["rank"] for r in features.grid_target_ranks(rows, targets, (0.2, 0.8), (60,)).collect()}
    assert got == {(0.2, 1): 2, (0.8, 1): 3, (0.2, 2): None, (0.8, 2): None, (0.2, 3): None, (0.8, 3): None}


def test_plateau_picks_the_configuration_nearest_to_the_default(spark):
    grid = spark.createDataFrame([(0.8, 20, 0.5), (0.5, 100, 0.4995), (0.5, 60, 0.4)], "svd_weight double, k int, ndcg_20 double")
    got = {(r.svd_weight, r.k): (r.near, r.chosen) for r in features.plateau(grid).collect()}
    assert got == {(0.8, 20): (True, False), (0.5, 100): (True, True), (0.5, 60): (False, False)}


def test_source_features_without_a_source(spark):
    row = features.source_features(spark.createDataFrame([(1, 2, None, 4)], "user_id long, film_id long, svd_rank long, popularity_rank long"), 8).first()
    assert (row.least_rank, row.svd_reciprocal, row.popularity_reciprocal, row.popularity_fraction, row.rank_gap) == (4, None, 0.25, 0.5, None)


def test_shelf_reports(spark):
    shelves = spark.createDataFrame([("a", 1, 10, 1), ("a", 1, 11, 2), ("b", 1, 11, 1), ("a", 2, 10, 1)], "key string, user_id long, film_id long, pos int")
    assert [(r.key_a, r.key_b, r.users, r.jaccard) for r in features.shelf_overlap(shelves).collect()] == [("a", "b", 1, 0.5)]
    sizes = {r.user_id: (r.categories, r.slots, r.films, r.most) for r in features.portfolio_sizes(shelves).collect()}
    assert sizes == {1: (2, 3, 2, 2), 2: (1, 1, 1, 1)}
    strata = spark.createDataFrame([(10, "HEAD"), (11, "TAIL")], "film_id long, stratum string")
    users = spark.range(1, 5).select(F.col("id").alias("user_id"))
    assert {r.key: (r.users, r.activation, r.films) for r in features.shelf_report(shelves, users, strata).collect()} == {"a": (2, 0.5, 2), "b": (1, 0.25, 1)}
