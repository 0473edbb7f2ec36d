"""Candidate lists in a user's row: the same as the joins and windows that they stand for, and not shuffled as rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import evaluation, features, quality, ranking, training, vectors
from marquee.plans import catalog, core
from marquee.sources import bridge
from marquee.sources.work import saved


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(5)
    logs = {(int(u), int(f)) for u, f in zip(rng.integers(1, 40, 500), rng.integers(1, 90, 500), strict=True)} | {(99, f) for f in range(1, 85)}
    rows = spark.createDataFrame([(u, f, float(rng.integers(1, 11)) / 2) for u, f in sorted(logs)], "user_id long, film_id long, rating double")
    items = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(1, 120)], "film_id long, vec array<double>")
    return saved(rows), items


def plain_popular(logs, popular, depth):
    seen, out = {}, []
    for r in logs.collect():
        seen.setdefault(r.user_id, set()).add(r.film_id)
    order = [(r.film_id, r.popularity_rank) for r in popular.orderBy("popularity_rank").collect()]
    for u, known in seen.items():
        out += [(u, f, p) for f, p in [x for x in order if x[0] not in known][:depth]]
    return sorted(out)


@pytest.mark.parametrize("most", [1 << 20, 3])
def test_popular_lists_whole(spark, world, most):
    logs, _ = world
    popular = ranking.popularity(logs)
    got = ranking.popularity_candidates(logs, popular, 20, most=most)
    assert sorted(tuple(r) for r in got.select("user_id", "film_id", "popularity_rank").collect()) == plain_popular(logs, popular, 20)


@pytest.mark.parametrize("item_rows", [16384, 16])
def test_lists_meet_as_rows_do(spark, world, item_rows):
    logs, items = world
    popular = ranking.popularity(logs)
    users = vectors.user_profiles(logs.where("user_id <> 7"), items)  # user 7 has one list only
    places = ranking.watched_places(logs, popular, 25)
    got = ranking.candidates(vectors.top_k_lists(users, items, 30, logs, item_rows=item_rows), places, 25)
    want = ranking.fused(ranking.union_sources(vectors.exact_top_k(users, items, 30, logs), ranking.popularity_candidates(logs, popular, 25)))
    assert got.count() == want.count() > 1000
    assert got.select(want.columns).exceptAll(want).count() == 0
    wanted = logs.sparkSession.createDataFrame([(1, 3), (1, 5), (7, 4), (1000, 1), (2, 100_000)], "user_id long, film_id long")
    some = ranking.candidates(vectors.top_k_lists(users, items, 30, logs), places, 25, wanted)
    assert some.select(want.columns).exceptAll(want.join(wanted, ["user_id", "film_id"], "left_semi")).count() == 0
    assert some.count() == want.join(wanted, ["user_id", "film_id"], "left_semi").count()


@pytest.mark.parametrize("item_rows", [16384, 16])
def test_lists_meet_places_on_the_way(spark, world, item_rows):
    logs, items = world
    popular = ranking.popularity(logs)
    users = vectors.user_profiles(logs.where("user_id <> 7"), items)  # user 7 has one list only
    places = ranking.watched_places(logs, popular, 25)
    got = ranking.candidates(vectors.top_k_lists(users, items, 30, logs, item_rows=item_rows, along=places.users), places, 25)
    want = ranking.candidates(vectors.top_k_lists(users, items, 30, logs, item_rows=item_rows), places, 25)
    assert got.count() == want.count() > 1000
    assert got.exceptAll(want).count() == 0
    wanted = spark.createDataFrame([(1, 3), (1, 5), (7, 4), (1000, 1), (2, 100_000)], "user_id long, film_id long")
    few = ranking.targeted(places, wanted)
    some = ranking.candidates(vectors.top_k_lists(users, items, 30, logs, item_rows=item_rows, along=few.users), few, 25)
    assert some.exceptAll(want.join(wanted, ["user_id", "film_id"], "left_semi").select(some.columns)).count() == 0
    assert some.count() == want.join(wanted, ["user_id", "film_id"], "left_semi").count()


def test_lists_of_vectors_are_not_shuffled(spark, world):
    logs, items = world
    svd, places = core.sources(logs, items, ranking.popularity(logs), 20)
    plan = ranking.candidates(svd, places, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join FullOuter" not in plan


@pytest.mark.parametrize("most", [1 << 20, 3])
def test_distances_meet_the_users_row(spark, world, most):
    logs, _ = world
    popular = ranking.popularity(logs)
    films = spark.createDataFrame([(f, 1900 + f if f % 7 else None, 60 + f % 9) for f in range(2, 88)], "film_id long, year long, runtime long")
    plain = {c: evaluation.weighted_preferences(logs, films, c) for c in ("year", "runtime")}
    want = features.distance_features(ranking.popularity_candidates(logs, popular, 20), films, plain)
    got = features.popular_distances(ranking.watched_places(logs, popular, 20, most), 20, films, evaluation.each_weighted(logs, films, ["year", "runtime"]))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    if most > 3:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            lines = operators(got.select("*"))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        above = lines[: next(i for i, x in enumerate(lines) if "Generate" in x)]
        assert sum("Exchange" in x and "Broadcast" not in x for x in above) == 0


def test_unwatched_popular_lists_are_ordered_once(spark, sf):
    lines = operators(catalog.QUERIES["unwatched_popular"](spark, sf))
    above = lines[: next(i for i, x in enumerate(lines) if "Generate" in x)]
    assert not any("Window" in x or ("Exchange" in x and "Broadcast" not in x) for x in above)


def test_split_deals_rows_not_bytes(spark, world, monkeypatch):
    logs, _ = world
    monkeypatch.setattr(evaluation, "HELD", 50)
    tasks = evaluation.tasks_for(logs)
    assert tasks == -(-logs.count() // 50) > spark.sparkContext.defaultParallelism
    rows = evaluation.holdout(logs, tasks=tasks)
    assert rows.rdd.getNumPartitions() == tasks
    assert sorted(map(str, rows.collect())) == sorted(map(str, evaluation.holdout(logs).collect()))


def test_leaks_are_sought_without_counting_the_context(spark):
    frame = lambda rows: saved(spark.createDataFrame(rows, "user_id long, film_id long"))
    df = quality.leaked(frame([(1, 1), (1, 2), (2, 5)]), frame([(1, 2), (1, 2), (2, 5), (3, 1)]), ["user_id", "film_id"])
    assert df.first().leaked == 2
    assert sum("Aggregate" in x for x in operators(df)) == 2  # the count's two halves


def test_unseen_films_of_repeated_rows(spark):
    items = spark.createDataFrame([(f,) for f in range(6)], "film_id long")
    known = spark.createDataFrame([(1, 0), (1, 0), (1, 3), (1, 3), (1, 77)], "user_id long, film_id long")
    wanted = spark.createDataFrame([(1, 9, 4), (2, 9, 6)], "user_id long, positive_id long, need long")
    df = training.unseen_films(wanted, known, items)
    films = lambda u: sorted(r.film_id for r in df.collect() if r.user_id == u)
    assert films(1) == [1, 2, 4, 5] and films(2) == list(range(6))
    assert not any("keys=[user_id" in x and "film_id" in x.split("functions")[0] for x in operators(df) if "Aggregate" in x)


def test_logs_are_those_of_the_sql(spark, tmp_path):
    day = "TIMESTAMP '2024-01-01'"
    lines = [  # order, film, supplier, line, quantity, price, flag, days after
        (1, 5, 1, 2, 10.0, 1.0, "N", 3), (1, 5, 1, 1, 20.0, 1.0, "R", 3), (1, 5, 2, 3, 30.0, 1.0, "N", 4), (2, 5, 1, 1, 40.0, 1.0, "N", 3), (3, 5, 1, 1, 50.0, 1.0, "N", 0),
        (2, 6, 2, 1, 5.0, 1.0, "R", 1), (2, 6, 1, 1, 15.0, 1.0, "N", 1), (1, 7, 1, 1, 25.0, 2.0, "N", 1), (1, 7, 1, 1, 35.0, 1.0, "N", 1), (9, 8, 1, 1, 5.0, 1.0, "N", 1), (None, 8, 1, 1, 5.0, 1.0, "N", 1),
    ]
    rows = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, d int")
    rows.withColumn("l_shipdate", F.expr(f"{day} + make_interval(0, 0, 0, d)")).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, 70), (2, 70), (3, 71), (4, 72)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = bridge.derived(spark, str(tmp_path), "logs")
    sql = re.sub(r"\b(lineitem|orders)\b", lambda m: f"parquet.`{tmp_path}/{m[0]}.parquet`", bridge.DERIVED["logs"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, spark.sql(sql).collect()), key=str)
    assert {(r.user_id, r.film_id): r.rating for r in got.collect()} == {(70, 5): None, (70, 6): 1.5, (70, 7): 3.5, (71, 5): 5.0}
    # Suppliers, lines and prices don't go on to the user.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    at = plan.index("RepartitionByExpression [user_id")
    assert not re.search("l_suppkey|l_linenumber|l_extendedprice", plan[at:].splitlines()[1])


def test_scores_round_as_spark_does(spark):
    a, b = (x.ravel() for x in np.meshgrid(np.arange(0, 300), np.arange(0, 300)))
    x = np.where(a > 0, 1.0 / (60 + np.maximum(a, 1)), 0.0) + np.where(b > 0, 1.0 / (60 + np.maximum(b, 1)), 0.0)
    want = [r.s for r in spark.range(len(x)).select("id", F.expr("id % 300 a"), F.expr("id div 300 b")).selectExpr("id", "nullif(a, 0) AS svd_rank", "nullif(b, 0) AS popularity_rank").withColumn("s", ranking.rrf_score()).orderBy("id").collect()]
    assert (ranking._rounded(x) == np.array(want)).all()


def operators(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


@pytest.mark.parametrize("name", ["popularity_candidates", "candidate_union"])
def test_lists_are_not_shuffled_as_rows(spark, sf, name):
    lines = operators(catalog.QUERIES[name](spark, sf))
    made = next(i for i, line in enumerate(lines) if "Generate" in line or "MapInArrow" in line)
    assert not any("Exchange" in line for line in lines[:made])


def test_entities_by_number_keep_names_and_repeats(spark):
    from marquee.operators import preferences

    logs = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0), (2, 2, 5.0), (2, 3, 4.5), (3, 9, 4.0), (1, 3, None)], "user_id long, film_id long, rating double")
    entity = spark.createDataFrame([(1, "genre", 5, "a"), (2, "genre", 5, "b"), (2, "genre", 5, "b"), (2, "director", 5, None), (3, "genre", 6, "c")], "film_id long, family string, entity_id long, name string")
    rated = logs.where("rating IS NOT NULL")
    want = rated.join(entity, "film_id").select("user_id", "rating", "family", "entity_id", "name")
    rows = preferences.entity_ratings(rated, entity)
    assert sorted(map(str, rows.select(want.columns).collect())) == sorted(map(str, want.collect()))
    got = {(r.user_id, r.family, r.entity_id): (r["name"], r.support) for r in preferences.entity_preferences(logs, entity).collect()}
    assert got == {(1, "genre", 5): ("b", 3), (1, "director", 5): (None, 1), (2, "genre", 5): ("b", 2), (2, "director", 5): (None, 1), (2, "genre", 6): ("c", 1)}
    # Behind the shuffle by user, entities aren't shuffled again as rows.
    lines = operators(rows.groupBy("user_id", "family", "entity_id").count())
    made = next(i for i, line in enumerate(lines) if "Generate" in line)
    assert not any("Exchange hash" in line for line in lines[:made])


@pytest.mark.parametrize("most", [1 << 20, 3])
def test_affinities_meet_as_rows_do(spark, world, most):
    from marquee.operators import evaluation

    logs, _ = world
    entity = spark.range(1, 90).select(F.col("id").alias("film_id"), F.explode(F.expr("filter(array(named_struct('family', 'genre', 'entity_id', id % 7), named_struct('family', 'director', 'entity_id', id % 11), named_struct('family', 'genre', 'entity_id', id % 5)), x -> id % 13 <> 0)")).alias("x")).select("film_id", "x.*", F.lit("n").alias("name"))
    popular, affinity = ranking.popularity(logs), evaluation.ranker_affinity(logs.where("user_id <> 7"), entity)
    want = evaluation.candidate_affinity(ranking.popularity_candidates(logs, popular, 20), entity, affinity)
    df = evaluation.popular_affinity(ranking.watched_places(logs, popular, 20, most), 20, entity, affinity)
    assert df.count() == want.count() > 500
    assert df.select(want.columns).exceptAll(want).count() == 0
    lines = operators(df)
    assert most == 3 or not any("Exchange hash" in line for line in lines[: next(i for i, line in enumerate(lines) if "MapInArrow" in line)])


def test_shelves_without_preferences_make_none(spark, sf, monkeypatch):
    from marquee.operators import preferences

    monkeypatch.setattr(preferences, "entity_preferences", lambda *_: pytest.fail("not needed"))
    assert catalog.QUERIES["shelf_classic_cinema"](spark, sf).count() > 0


def test_samples_shuffle_candidates_once(spark, world):
    from marquee.operators import evaluation

    logs, _ = world
    rows = ranking.popularity_candidates(logs, ranking.popularity(logs), 60).withColumn("membership", F.lit("both"))
    labels = rows.where("film_id % 9 = 0").select("user_id", "film_id", F.lit(2).alias("label"))
    got = evaluation.sampled_groups(rows, labels, 20)
    assert got.where("label > 0").exceptAll(labels.withColumn("taken_by", F.lit("positive"))).count() == 0
    assert got.where("label > 0").count() == labels.count()
    assert got.groupBy("user_id").count().where("count > 20").join(labels.groupBy("user_id").count().where("count > 20"), "user_id", "left_anti").count() == 0
    lines = operators(got)
    assert sum("Exchange" in line for line in lines[: next(i for i, line in enumerate(lines) if "Generate" in line)]) == 1


def test_large_buckets_are_merged_in_parts(spark, tmp_path):
    from marquee.streaming.keyed import BUCKET, KeyedTable, last_by

    schema = spark.createDataFrame([], "k bigint, v bigint, at bigint").schema
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], schema, 4, part_rows=100)
    widest = []

    def fold(both):
        widest.append(max(r["count"] for r in both.groupBy(F.spark_partition_id(), BUCKET).count().collect()))
        return last_by(["k"], ["v"], ["at"])(both)

    for batch in range(3):
        table.merge(spark.range(batch * 500, batch * 500 + 1000).selectExpr("id AS k", f"id * 10 + {batch} AS v", f"{batch}L AS at"), batch, fold)
    assert sorted((r.k, r.v) for r in table.read().collect()) == [(k, k * 10 + min(k // 500, 2)) for k in range(2000)]
    assert max(widest) < 250  # a whole bucket has 250 to 500 rows


def test_a_query_derives_its_logs_once(spark, sf):
    text = "\n".join(operators(catalog.QUERIES["watched_with_ratings"](spark, sf)))
    assert "lineitem.parquet" not in text and "Window" not in text


def test_svd_hands_on_a_row_a_film_and_part(spark, world):
    logs, _ = world
    rated = logs.groupBy("user_id", "film_id").agg(F.max("rating").alias("rating"))
    links = saved(vectors._links(rated, 150))
    parts = links.select("p").distinct().count()
    assert parts > 2 and links.selectExpr("sum(size(u))").first()[0] == rated.count()
    block = saved(links.groupBy("film_id").agg(F.collect_list("p").alias("parts")).selectExpr("film_id", "parts", "double(film_id) q0", "1.0D q1"))
    matrix = {(r.user_id, r.film_id): r.rating for r in rated.collect()}
    users, films = sorted({u for u, _ in matrix}), sorted({f for _, f in matrix})
    a = np.array([[matrix.get((u, f), 0.0) for f in films] for u in users])
    sums = a @ np.array([[float(f), 1.0] for f in films])
    rows = vectors._passed(links, block)
    assert rows.count() == links.count() < rated.count()
    got = {r.film_id: (r.a, r.b) for r in rows.groupBy("film_id").agg(F.sum("q0").alias("a"), F.sum("q1").alias("b")).collect()}
    assert np.allclose([got[f] for f in films], a.T @ sums)
    assert np.allclose(vectors._collected(vectors._passed(links, block, gram=True), 2), sums.T @ sums)
    one, many = (np.array([r.vec for r in vectors.truncated_svd(logs, 4, part=p).orderBy("film_id").collect()]) for p in (vectors.PART, 150))
    assert np.allclose(one @ one.T, many @ many.T, atol=1e-6)  # signs of columns are open


@pytest.mark.parametrize("item_rows", [16384, 100])
def test_best_of_many_items_with_ties_and_gaps(spark, item_rows):
    rng = np.random.default_rng(3)
    base = np.round(rng.normal(size=(40, 3)), 2)
    y = {i: base[i % 40] if i % 7 else np.round(rng.normal(size=3), 7) for i in range(900)} | {900: np.array([np.nan, 1, 1]), 901: np.array([np.inf, 0, 0])}
    x = {i: np.round(rng.normal(size=3), 1) for i in range(30)} | {30: np.zeros(3)}
    seen = {(u, int(f)) for u in x for f in rng.integers(0, 900, 60)} | {(0, f) for f in range(895)}
    frame = lambda d, key: spark.createDataFrame([(i, [float(c) for c in v]) for i, v in d.items()], f"{key} long, vec array<double>")
    got = vectors.exact_top_k(frame(x, "user_id"), frame(y, "film_id"), 12, spark.createDataFrame(sorted(seen), "user_id long, film_id long"), item_rows=item_rows)
    found = sorted((r.user_id, r.svd_rank, r.film_id, round(r.svd_score, 6)) for r in got.collect())
    want = []
    for u, a in x.items():
        s = [(-round(float(a @ v), 6), f) for f, v in y.items() if (u, f) not in seen and np.isfinite(a @ v)]
        want += [(u, n + 1, f, -c) for n, (c, f) in enumerate(sorted(s)[:12])]
    assert found == sorted(want)


def test_only_the_best_scores_are_ordered():
    scores = np.random.default_rng(4).normal(size=(50, 4000))
    scores[0, 5:] = -np.inf
    owner, at = vectors.near_best(scores, 10)
    assert len(owner) < 50 * 40
    for i in range(1, 50):
        assert set(np.argsort(-scores[i])[:10]) <= set(at[owner == i])
    assert list(at[owner == 0]) == [0, 1, 2, 3, 4]


def test_popularity_counts_films_once(spark, sf, world):
    logs, _ = world
    text = "\n".join(operators(ranking.with_strata(ranking.popularity(logs))))
    assert "rating" not in text  # ratings were read when films were counted, not again for each part of the ranks


def test_profile_meets_its_logs_in_one_shuffle(spark):
    from marquee.operators import identity

    rng = np.random.default_rng(6)
    frame = lambda rows, schema: spark.createDataFrame([tuple(r) for r in rows], schema)
    draws = zip(*(rng.integers(0, n, 400).tolist() for n in (8, 60, 11)), strict=True)
    entries = [(f"u{u + 1}", u + 1, f"s{f}", None if r == 0 else r / 2, i) for i, (u, f, r) in enumerate(draws)]
    films = {f"s{f}": f // 2 for f in range(40)}  # two slugs a film
    logs = {(u, f): None if (u + f) % 5 == 0 else (u + f) % 11 / 2 for u in range(1, 9) for f in range(0, 20, 2)}
    queue = {f"s{f}": ("PENDING", "FILTERED", "FAILED")[f % 3] for f in range(30, 55)}
    waiting = {(f"u{u}", f"s{f}"): (u + f) % 4 / 1.0 for u in range(1, 9) for f in range(40, 60, 2)}
    schema = "username string, user_id long, slug string, rating double, seq int"
    got = identity.reconcile(frame(entries, schema), frame(films.items(), "slug string, film_id long"), frame(((*k, r) for k, r in logs.items()), "user_id long, film_id long, rating double"), frame(queue.items(), "slug string, status string"), frame(((*k, r) for k, r in waiting.items()), "username string, slug string, rating double"))
    want = []
    for name, u, s, r, _ in {(x[1], x[2]): x for x in entries}.values():
        f = films.get(s)
        if f is not None:
            action = "insert" if (u, f) not in logs else "update" if logs[u, f] != r else "keep"
        else:
            action = "enqueue" if s not in queue else "terminal" if queue[s] != "PENDING" else "refresh" if (name, s) in waiting and waiting[name, s] != r else "wait"
        want.append((name, u, s, f, r, action))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select("username", "user_id", "slug", "film_id", "rating", "action").collect())
    assert {w[-1] for w in want} == {"insert", "update", "keep", "enqueue", "terminal", "refresh", "wait"}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = operators(got.select("*"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("Exchange" in x for x in lines[: next(i for i, x in enumerate(lines) if "Window" in x)]) == 2
