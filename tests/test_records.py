"""Record cleaning, writers with gates, numbering by ranges and top-K search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.functions import cleaning as C
from marquee.operators import evaluation as E
from marquee.operators import identity, quality, vectors
from marquee.sources import files


def test_refresh_years_fail_outside_january_and_july(spark):
    rows = spark.sql("SELECT DATE'2024-01-05' AS d UNION ALL SELECT DATE'2024-07-31'")
    assert sorted(r.y for r in rows.select(C.refresh_years(F.col("d")).alias("y")).collect()) == [[2023], [2023, 2024]]
    with pytest.raises(Exception, match="January and July"):
        spark.sql("SELECT DATE'2024-03-05' AS d").select(C.refresh_years(F.col("d"))).collect()


def test_watches_without_slug_go_and_bad_ratings_are_unrated(spark):
    rows = spark.createDataFrame([("a", " x ", "4.5"), ("a", " ", "4"), ("a", None, "4"), ("a", "y", "4.3"), ("a", "z", None), ("a", "w", "n/a")], "username string, slug string, rating string")
    assert sorted((r.slug, r.rating) for r in identity.valid_watches(rows).collect()) == [("w", None), ("x", 4.5), ("y", None), ("z", None)]


def test_films_of_years_keep_unknown_years(spark):
    films = spark.createDataFrame([(1, 1990), (2, None), (3, 1991)], "film_id long, year long")
    years = spark.createDataFrame([(1990,), (None,)], "year long")
    assert sorted(r.film_id for r in identity.of_years(films, years).collect()) == [1, 2]
    assert [r.film_id for r in identity.of_years(films, years, unknown=False).collect()] == [1]


def test_append_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "logs")
    good = spark.createDataFrame([(1, 2, 3.5), (1, 3, None)], "user_id long, film_id long, rating double")
    files.append_interactions(good, path)
    for bad in ([(1, None, 2.0)], [(2, 2, 1.0), (2, 2, 1.5)]):
        with pytest.raises(quality.DataError):
            files.append_interactions(spark.createDataFrame([(5, 5, 1.0), *bad], good.schema), path)
    assert spark.read.parquet(path).count() == 2


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 0.0]), (1, [0.0, 1.0])], [(1, [2.0, 0.0])], [(1, [1.0, 0.0]), (2, [1.0])], [(1, [float("nan"), 1.0])]])
def test_broken_vectors_fail(spark, tmp_path, rows):
    files.write_vectors(spark.createDataFrame(rows, "film_id long, vec array<double>"), str(tmp_path / "v"))
    with pytest.raises(quality.DataError):
        files.read_vectors(spark, str(tmp_path / "v"))


def test_numbers_by_ranges(spark):
    rows = spark.range(0, 3000, 1, 7).select(F.concat(F.lit("Cu"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("name"))
    got = {r.name: r.number for r in quality.ranged(rows, ["name"]).collect()}
    assert got == {f"Cu{i:05d}": i + 1 for i in range(3000)}
    assert quality.ranged(rows.limit(0), ["name"]).collect() == []


def test_new_identities_of_nothing_known(spark):
    names = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "name string")
    known = spark.createDataFrame([], "name string, id long")
    assert sorted((r.name, r.id) for r in identity.new_identities(names, known).collect()) == [("a", 1), ("b", 2)]


def test_top_k_leaves_out_what_was_seen_and_breaks_ties_by_id(spark):
    rng = np.random.default_rng(5)
    items = np.round(rng.normal(size=(300, 4)), 1)
    items[100:200] = items[:100]  # ties
    users = np.round(rng.normal(size=(40, 4)), 1)
    seen = {u: set(rng.choice(300, 250 if u == 0 else 299 if u == 1 else 20, replace=False).tolist()) for u in range(39)}
    q = spark.createDataFrame([(u, v.tolist()) for u, v in enumerate(users)], "user_id long, vec array<double>")
    i = spark.createDataFrame([(f, v.tolist()) for f, v in enumerate(items)], "film_id long, vec array<double>")
    x = spark.createDataFrame([(u, f) for u, s in seen.items() for f in s], "user_id long, film_id long")
    got = vectors.exact_top_k(q, i, 10, x, query_rows=16, item_rows=64).collect()
    scores = np.round(users @ items.T, 6)
    for u in range(40):
        want = sorted((f for f in range(300) if f not in seen.get(u, ())), key=lambda f: (-scores[u, f], f))[:10]
        assert [r.film_id for r in sorted((r for r in got if r.user_id == u), key=lambda r: r.svd_rank)] == want


def test_profiles_without_vectors_or_evidence(spark):
    logs = spark.createDataFrame([(1, 1, 5.0), (2, 1, 3.0), (3, 9, 4.0), (4, 2, None)], "user_id long, film_id long, rating double")
    items = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "film_id long, vec array<double>")
    assert [(r.user_id, r.vec) for r in vectors.user_profiles(logs, items).collect()] == [(1, [1.0, 2.0])]
    assert vectors.user_profiles(logs, items.limit(0)).collect() == []


def test_allocation_report_against_brute_force(spark):
    targets = [("HEAD", 1, None), ("MID", 30, 2), ("TAIL", None, None), ("HEAD", None, 9)]
    found = [(1, 10, 1, None), (1, 11, None, 1), (1, 12, 5, 5), (2, 10, 3, 1), (2, 13, 8, None)]
    shares = {10: 1.0, 11: 0.5, 12: 0.25, 13: 0.0}
    t = spark.createDataFrame(targets, "stratum string, svd_rank int, popularity_rank int")
    c = spark.createDataFrame(found, "user_id long, film_id long, svd_rank int, popularity_rank int")
    s = spark.createDataFrame(list(shares.items()), "film_id long, percentile double")
    for r in E.allocation_report(t, c, s, [4, 10], [0.2, 0.5]).collect():
        a = round(r.budget * r.ratio)
        b = r.budget - a
        inside = [(x is not None and x <= a) or (y is not None and y <= b) for _, x, y in targets]
        got = [row for row in found if (row[2] is not None and row[2] <= a) or (row[3] is not None and row[3] <= b)]
        assert r.recall == sum(inside) / 4 and r.recall_head == (inside[0] + inside[3]) / 2
        assert r.mean_size == len(got) / 2 and r.films == len({g[1] for g in got})
        assert r.mean_percentile == pytest.approx(sum(shares[g[1]] for g in got) / len(got), abs=1e-6)
