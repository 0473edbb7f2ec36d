import pytest

from marquee.operators.quality import DataError
from marquee.sources import files


def test_catalog_and_logs(spark, tmp_path):
    (tmp_path / "c.csv").write_text("title;original_title;slug;year;runtime;genres\n A ;;a;1999;90.0;['X', ' Y ']\nB;Bee;b;x;;broken\n")
    got = {r.slug: r for r in files.catalog_csv(spark, str(tmp_path / "c.csv")).collect()}
    assert (got["a"].title, got["a"].original_title, got["a"].year, got["a"].runtime, got["a"].genres) == ("A", "A", 1999, 90, ["X", "Y"])
    assert (got["b"].original_title, got["b"].year, got["b"].genres) == ("Bee", None, [])
    (tmp_path / "l.csv").write_text("user_id;username;slug;rating\n1;u;a;4.5\n1;u;zz;4.5\n2;;a;4\n3;v;b;4.2\n")
    slugs = spark.createDataFrame([("a", 1), ("b", 2)], "slug string, film_id long")
    assert [(r.user_id, r.film_id, r.rating) for r in files.logs_csv(spark, str(tmp_path / "l.csv"), slugs).collect()] == [(1, 1, 4.5)]


def test_cohort_is_strict(spark, tmp_path):
    slugs = files.slug_mapping(spark.createDataFrame([("a", 1), ("b", 2)], "slug string, film_id long"))
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("user_id;username;slug;rating\n1;u;a;4.5\n1;u;a;4.5\n2;v;zz;1.0\n")
    bad.write_text("user_id;username;slug;rating\n1;u;a;4.7\n")
    logs, summary = files.cohort_csv(spark, str(good), slugs)
    assert logs.count() == 1 and summary.first().asDict() == {"csv_rows": 3, "resolved": 2, "unresolved": 1, "duplicates": 1, "users": 1, "films": 1}
    with pytest.raises(DataError):
        files.cohort_csv(spark, str(bad), slugs)
    with pytest.raises(DataError):
        files.slug_mapping(spark.createDataFrame([("a", 1), ("a", 2)], "slug string, film_id long"))


def test_export_pairs(spark, tmp_path):
    (tmp_path / "ann").mkdir()
    (tmp_path / "ann/watched.csv").write_text("Date,Name,Year,Film URI\n2020-01-01,F,1990,u1\n2020-01-02,G,,u2\n")
    (tmp_path / "ann/ratings.csv").write_text("Date,Name,Year,Film URI,Rating\n2020-01-01,F,1990,u1,4.5\n2020-01-01,H,1990,u9,1\n")
    got = sorted((r.username, r.uri, r.year, r.rating) for r in files.export_pairs(spark, str(tmp_path)).collect())
    assert got == [("ann", "u1", 1990, 4.5), ("ann", "u2", None, None)]


def test_popularity_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(5, 9, 1), (7, 3, 2)], "film_id long, positives long, popularity_rank long")
    files.write_popularity(rows, str(tmp_path / "p"))
    assert files.read_popularity(spark, str(tmp_path / "p")).count() == 2
    files.write_popularity(rows.selectExpr("film_id", "positives", "popularity_rank + 1 AS popularity_rank"), str(tmp_path / "q"))
    with pytest.raises(DataError):
        files.read_popularity(spark, str(tmp_path / "q"))


def test_partitions_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 42, 0, "train"), (2, 42, 0, "test")], "user_id long, seed int, fold int, partition string")
    files.write_partitions(rows, str(tmp_path / "d"))
    assert [r.user_id for r in files.read_partition(spark, str(tmp_path / "d"), 42, 0, "test").collect()] == [2]


def test_work_tables_lie_in_the_applications_folder_and_go(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from marquee.sources import work

    class Unset:  # a local session without a shared folder
        sparkContext, conf = spark.sparkContext, type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    assert work.folder(spark).startswith(f"{spark.conf.get('spark.checkpoint.dir')}/marquee-{spark.sparkContext.applicationId}/")
    one, two = work.folder(Unset), work.folder(Unset)
    assert one != two and Path(one).parent == Path(two).parent
    monkeypatch.setattr(work, "_root", lambda s: str(tmp_path / "mine"))
    assert work.saved(spark.range(3)).count() == 3 and (tmp_path / "mine").exists()
    work.clear(spark)
    assert not (tmp_path / "mine").exists()
