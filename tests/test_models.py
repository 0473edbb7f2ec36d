"""Model versions: decisions, failed builds, promotion and retention."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marquee.operators import ranking
from marquee.operators.quality import DataError
from marquee.sources import files
from marquee.sources.models import ModelStore

LOGS = "user_id long, film_id long, rating double"
NOW = datetime(2024, 1, 1)
ROWS = [(u, f, 0.5 + (u * 7 + f) % 10 / 2) for u in range(6) for f in range(5) if (u + f) % 3]


def _plain(rated, path):
    """A build of unit vectors, so that no factors are computed."""
    files.write_vectors(rated.select("film_id").distinct().select("film_id", F.array(F.lit(0.6), F.lit(0.8)).alias("vec")), f"{path}/item_vectors")
    files.write_popularity(ranking.popularity(rated), f"{path}/popularity")


def _state(path):
    return {p.relative_to(path): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_runs_promote_when_due_and_keep_one_older_version(spark, tmp_path):
    store, logs = ModelStore(spark, str(tmp_path)), spark.createDataFrame(ROWS, LOGS)
    run = lambda day, rows=logs, **k: store.retrain(rows, NOW + timedelta(days=day), build=_plain, users=2, films=9, days=30, **k)
    first = run(0)
    assert (first["outcome"], first["version"], first["reasons"], first["user_delta"]) == ("promoted", 1, ["users"], 6)
    before = _state(tmp_path)
    assert (run(10)["outcome"], run(10)["version"]) == ("not due", 1) and _state(tmp_path) == before
    assert run(10, forced=True)["version"] == 2
    assert run(41)["reasons"] == ["age"] and store.promoted() == [2, 3]
    assert not (tmp_path / "models" / "1").exists() and store.vectors(2).count() == 5
    more = spark.createDataFrame([*ROWS, (7, 1, 4.0), (8, 1, 4.5), (9, 9, None)], LOGS)
    got = run(42, more)
    assert (got["user_delta"], got["interaction_delta"], got["new_films"], got["reasons"]) == (2, 2, 0, ["users"]) and store.promoted() == [3, 4]
    assert store.manifest(4) == {"trained_at": NOW + timedelta(days=42), "users": 8, "interactions": len(ROWS) + 2, "films": 5}


def test_a_failed_build_leaves_the_served_version(spark, tmp_path):
    store, logs = ModelStore(spark, str(tmp_path)), spark.createDataFrame(ROWS, LOGS)
    store.retrain(logs, NOW, forced=True, build=_plain)
    before = _state(tmp_path)

    def one_film_short(rated, path):
        _plain(rated.where("film_id <> 3"), path)

    def other_films(rated, path):
        files.write_vectors(rated.select((F.col("film_id") + 1).alias("film_id")).distinct().select("film_id", F.array(F.lit(1.0)).alias("vec")), f"{path}/item_vectors")
        files.write_popularity(ranking.popularity(rated), f"{path}/popularity")

    def no_unit_vectors(rated, path):
        files.write_vectors(rated.select("film_id").distinct().select("film_id", F.array(F.lit(2.0)).alias("vec")), f"{path}/item_vectors")
        files.write_popularity(ranking.popularity(rated), f"{path}/popularity")

    def stops(rated, path):
        _plain(rated, path)
        raise RuntimeError("stopped")

    for build, error in ((one_film_short, DataError), (other_films, DataError), (no_unit_vectors, DataError), (stops, RuntimeError)):
        with pytest.raises(error):
            store.retrain(logs, NOW, forced=True, build=build)
        assert _state(tmp_path) == before and store.promoted() == [1]
    for broken in ([(1, 2, float("nan"))], [(1, 2, 3.0), (1, 2, 4.0)], [(1, 2, None)], []):
        with pytest.raises(DataError):
            store.retrain(spark.createDataFrame(broken, LOGS), NOW, forced=True, build=_plain)
        assert _state(tmp_path) == before


def test_what_a_stopped_build_left_goes_with_the_next(spark, tmp_path):
    store, logs = ModelStore(spark, str(tmp_path)), spark.createDataFrame(ROWS, LOGS)
    logs.write.parquet(str(tmp_path / "models" / "1" / "rated"))
    logs.write.parquet(str(tmp_path / "models" / "1" / "left"))
    assert store.retrain(logs, NOW, forced=True, build=_plain)["version"] == 1
    assert not (tmp_path / "models" / "1" / "left").exists()


def test_the_snapshot_decides_again(spark, tmp_path):
    """Copies of a pair count as interactions of the logs, users and films don't; here rows vanish between the two decisions."""
    store, logs = ModelStore(spark, str(tmp_path)), spark.createDataFrame(ROWS, LOGS)
    whole = store.decision

    def before_the_users_left(rows, now, forced=False, **limits):
        got = whole(rows, now, forced, **limits)
        store.decision = whole
        return got | {"reasons": ["users"]}

    store.decision = before_the_users_left
    got = store.retrain(logs, NOW, build=_plain, users=7)
    assert (got["outcome"], got["version"], got["reasons"]) == ("not due on the snapshot", None, [])
    assert store.promoted() == [] and not (tmp_path / "models" / "1").exists()
