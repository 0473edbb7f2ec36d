"""Keyed tables, retraining decisions across runs, pending rows that expire and late rows."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marquee.operators import evaluation
from marquee.streaming import jobs, watch
from marquee.streaming.keyed import KeyedTable, last_by


def _files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def _table(spark, path, buckets=16):
    schema = spark.createDataFrame([], "id long, value double, seq long").schema
    return KeyedTable(spark, str(path), ["id"], schema, buckets)


def _put(table, spark, rows, batch):
    table.merge(spark.createDataFrame(rows, "id long, value double, seq long"), batch, last_by(["id"], ["value"], ["seq"]))


def test_a_batch_writes_only_the_buckets_of_its_keys(spark, tmp_path):
    table = _table(spark, tmp_path)
    _put(table, spark, [(i, float(i), i) for i in range(2000)], 0)
    before = _files(tmp_path / "data")
    _put(table, spark, [(7, -1.0, 5000), (7, -2.0, 4000), (9, -3.0, 1)], 1)
    new = set(_files(tmp_path / "data")) - set(before)
    assert len(new) == 2 and set(before) <= set(_files(tmp_path / "data"))
    size = lambda names: sum(Path(n).stat().st_size for n in names)
    assert size(new) < size(before) / 4
    got = {r.id: r.value for r in table.read().collect()}
    assert len(got) == 2000 and got[7] == -1.0 and got[9] == 9.0


def test_a_replayed_batch_changes_nothing_and_old_files_go(spark, tmp_path):
    table = _table(spark, tmp_path)
    for batch in range(5):
        _put(table, spark, [(i, float(batch), batch) for i in range(batch, 300, batch + 1)], batch)
    want = sorted(map(tuple, table.read().collect()))
    _put(table, spark, [(i, 4.0, 4) for i in range(4, 300, 5)], 4)
    assert sorted(map(tuple, table.read().collect())) == want
    assert table.batches() == [3, 4]
    kept = {(b, n) for batch in (3, 4) for b, n in table.manifest(batch).items()}
    assert {(int(p.name.split("=")[1]), int(p.parent.name)) for p in (tmp_path / "data").glob("*/*=*")} == kept
    _put(table, spark, [], 5)
    assert sorted(map(tuple, table.read().collect())) == want


def test_a_batch_that_fails_before_its_manifest_is_not_seen(spark, tmp_path):
    table = _table(spark, tmp_path)
    _put(table, spark, [(1, 1.0, 1)], 0)
    with pytest.raises(Exception, match="no such"):
        table.merge(spark.createDataFrame([(1, 2.0, 2)], table.schema), 1, lambda both: both.withColumn("value", F.raise_error(F.lit("no such"))))
    assert [r.value for r in table.read().collect()] == [1.0] and table.batches() == [0]
    _put(table, spark, [(1, 2.0, 2)], 1)
    assert [r.value for r in table.read().collect()] == [2.0]


def test_null_keys_have_a_bucket(spark, tmp_path):
    table = _table(spark, tmp_path)
    _put(table, spark, [(None, 1.0, 1), (None, 2.0, 2), (3, None, 1)], 0)
    assert sorted(map(tuple, table.read().collect()), key=repr) == [(3, None, 1), (None, 2.0, 2)]
    assert _table(spark, tmp_path / "empty").read().collect() == []


LOGS = "user_id long, film_id long, rating double"


def test_retraining_decisions_equal_a_recount(spark, tmp_path):
    path, work, start = str(tmp_path / "logs"), str(tmp_path / "work"), datetime(2024, 1, 1)
    pieces = [[(u, f, 3.0) for u in range(40) for f in range(u % 5, 60, 7)], [(u, f, 4.0) for u in range(30, 160) for f in range(50, 58)] + [(1, 1, 2.0), (1, 1, None), (500, 500, None)], [(3, f, 1.0) for f in range(400)], []]
    seen, trained = [], None
    for k, piece in enumerate(pieces):
        now = start + timedelta(days=70 * k)
        spark.createDataFrame(piece, LOGS).write.mode("append").parquet(path)
        seen += piece
        logs = spark.createDataFrame([r for r in seen if r[2] is not None], LOGS).dropDuplicates(["user_id", "film_id"])
        base = spark.createDataFrame([(trained[0], trained[1], 70.0 * (k - trained[3]))] if trained else [], "users long, interactions long, age_days double")
        films = spark.createDataFrame([(f,) for f in trained[2]] if trained else [], "film_id long")
        want = evaluation.retraining_decision(logs, films, base).first()
        got = watch.retrain_trigger(spark, path, work, now).first()
        assert tuple(got) == tuple(want)
        assert tuple(watch.retrain_trigger(spark, path, work, now).first()) == tuple(want)  # nothing new: the same again
        if got.reasons:
            watch.mark_trained(spark, work, now)
            rows = logs.collect()
            trained = (len({r.user_id for r in rows}), len(rows), {r.film_id for r in rows}, k)
    assert trained[3] == 2


@pytest.mark.parametrize(("users", "films", "reasons"), [(99, 249, []), (100, 249, ["users"]), (101, 249, ["users"]), (99, 250, ["films"]), (99, 251, ["films"]), (100, 250, ["users", "films"])])
def test_thresholds(spark, users, films, reasons):
    rows = spark.createDataFrame([(users, 0, films, 10.0, False, True)], "user_delta long, interaction_delta long, new_films long, age_days double, unknown boolean, model boolean")
    assert evaluation.retraining_reasons(rows).first().reasons == reasons


def test_unknown_counts_and_age_and_force(spark, tmp_path):
    path, work = str(tmp_path / "logs"), str(tmp_path / "work")
    spark.createDataFrame([(1, f, 3.0) for f in range(300)], LOGS).write.parquet(path)
    watch.training_counts(spark, path, work)
    watch.mark_trained(spark, work, datetime(2024, 1, 1), {"users": -1, "films": 20, "interactions": -1})
    got = watch.retrain_trigger(spark, path, work, datetime(2024, 9, 1)).first()
    assert got.reasons == ["bootstrap"] and (got.user_delta, got.interaction_delta, got.new_films) == (0, 0, 280)
    watch.mark_trained(spark, work, datetime(2024, 1, 1))
    assert watch.retrain_trigger(spark, path, work, datetime(2024, 1, 1) + timedelta(days=180)).first().reasons == ["age"]
    assert watch.retrain_trigger(spark, path, work, datetime(2024, 1, 2), forced=True).first().reasons == ["forced"]


def test_pending_rows_match_across_runs_or_expire(spark, tmp_path):
    t = lambda hour: datetime(2024, 1, 1) + timedelta(hours=hour)
    pending = [[(1, "a", t(0)), (2, "b", t(1)), (3, "c", t(2))], [(4, "d", t(50)), (5, None, t(51))], [(6, "e", t(120)), (7, "a", t(121))]]
    arrivals = [[("z", t(1), 90)], [("a", t(20), 91), ("b", t(30), 92), ("a", t(23), 93), (None, t(60), 94)], [("d", t(70), 95), ("e", t(130), 96)]]
    p, a, work = (str(tmp_path / n) for n in ("p", "a", "w"))
    seen = []
    for x, y in zip(pending, arrivals, strict=True):
        spark.createDataFrame(x, "event_id long, slug string, ts timestamp").write.mode("append").parquet(p)
        spark.createDataFrame(y, "slug string, arrived_at timestamp, film_id long").write.mode("append").parquet(a)
        seen.append({(r.event_id, r.film_id) for r in watch.pending_stream(spark, p, a, "24 hours", work).collect()})
    assert seen[0] == set()
    assert seen[1] == {(1, 91), (1, 93)}
    assert seen[2] == {(1, 91), (1, 93), (2, None), (3, None), (4, 95), (5, None), (6, 96)}  # 7 waits


def test_late_rows_are_counted_and_kept_aside(spark, tmp_path):
    t = lambda minute: datetime(2024, 1, 1) + timedelta(minutes=minute)
    path, work = str(tmp_path / "p"), str(tmp_path / "w")
    pieces = [[(1, 5.0, t(0), 1), (2, 6.0, t(30), 2)], [(1, 7.0, t(19), 3), (1, 8.0, t(20), 4), (2, 9.0, t(25), 5), (3, 1.0, t(100), 6)], [(3, 2.0, t(90), 7), (1, 3.0, None, 8), (4, 4.0, t(10), 9)]]
    for piece in pieces:
        spark.createDataFrame(piece, "id long, value double, at timestamp, seq long").write.mode("append").parquet(path)
        table, late, progress = watch.late_upserts(spark, path, work, ["id"], "value", "at", "seq", 600)
    assert {r.id: r.value for r in table.collect()} == {1: 8.0, 2: 6.0, 3: 1.0}  # by time, not by arrival
    assert sorted(r.seq for r in late.collect()) == [3, 9]
    assert sorted((r.batch, r.seen, r.late, r.latest) for r in progress.collect()) == [(0, 2, 0, t(30)), (1, 4, 1, t(100)), (2, 3, 1, t(100))]


def test_spark_drops_as_many_windows_rows_behind_the_watermark(spark, tmp_path):
    t = lambda minute: datetime(2024, 1, 1) + timedelta(minutes=minute)
    path, check = str(tmp_path / "p"), str(tmp_path / "c")
    dropped = []
    for piece in ([("x", 1.0, t(0)), ("x", 1.0, t(200))], [("x", 1.0, t(5)), ("x", 1.0, t(201)), ("y", 1.0, t(400))], [("y", 1.0, t(100))]):
        spark.createDataFrame(piece, "event_type string, value double, ts timestamp").write.mode("append").parquet(path)
        counted = jobs.windowed(jobs._source(spark, path), "10 minutes", late="30 minutes")
        run = counted.writeStream.outputMode("append").option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{tmp_path}/out/{batch}")).start()
        run.awaitTermination()
        dropped.append(sum(s.numRowsDroppedByWatermark for p in run.recentProgress for s in p.stateOperators))
    assert dropped == [0, 1, 1]
    rows = spark.read.parquet(f"{tmp_path}/out/*").collect()
    assert sorted((r.start, r.event_type, r.n) for r in rows) == [(t(0), "x", 1), (t(200), "x", 2)]


def test_rolling_top_adds_up_over_runs(spark, tmp_path):
    import random
    from collections import Counter

    rng, start = random.Random(5), datetime(2024, 3, 1)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, 5, None]), start + timedelta(hours=rng.randrange(24 * 12)), rng.random()) for _ in range(400)]
    schema, path, work, seen = "item long, ts timestamp, value double", str(tmp_path / "in"), str(tmp_path / "work"), []
    for part in (rows[:200], rows[200:390], [], rows[390:] + [(1, None, 1.0)]):
        if part:
            spark.createDataFrame(part, schema).write.mode("append").parquet(path)
        seen += [r for r in part if r[1] is not None]
        top = watch.rolling_top_stream(spark, path, work, "item", F.col("value") >= 0.3, "3 days", "1 day", 2, buckets=4)
        n = Counter((d, i) for i, t, v in seen if v >= 0.3 for d in (t.replace(hour=0) - timedelta(days=x) for x in range(3)))
        want = set()
        for d in {d for d, _ in n}:
            best = sorted((-c, i is not None, i or 0) for (e, i), c in n.items() if e == d)[:2]
            want |= {(d, i if known else None, -c, p + 1) for p, (c, known, i) in enumerate(best)}
        assert {tuple(r) for r in top.collect()} == want
