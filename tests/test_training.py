import datetime

from pyspark.sql import functions as F

from marquee.functions import reasons
from marquee.operators import training
from marquee.sources import work
from marquee.streaming import jobs


def test_unseen_films_are_unknown_and_distinct(spark):
    items = spark.range(1, 21).select((F.col("id") * 3).alias("film_id"))
    known = spark.createDataFrame([(1, 3), (1, 6), (1, 30), (2, 60), (3, 999)] + [(4, 3 * i) for i in range(1, 21)], "user_id long, film_id long")
    wanted = spark.createDataFrame([(u, p, 5) for u in (1, 2, 3, 4, 5) for p in (7, 8)], "user_id long, positive_id long, need int")
    got = {}
    for r in training.unseen_films(wanted, known, items).collect():
        got.setdefault((r.user_id, r.positive_id), []).append(r.film_id)
    assert set(got) == {(u, p) for u in (1, 2, 3, 5) for p in (7, 8)}
    assert all(len(set(v)) == 5 for v in got.values())
    assert not {3, 6, 30} & set(got[1, 7] + got[1, 8]) and 60 not in got[2, 7] + got[2, 8]


def test_unseen_films_repeat_where_there_are_too_few(spark):
    items = spark.range(3).select(F.col("id").alias("film_id"))
    known = spark.createDataFrame([(1, 0), (1, 2)], "user_id long, film_id long")
    wanted = spark.createDataFrame([(1, 9, 3)], "user_id long, positive_id long, need int")
    assert [r.film_id for r in training.unseen_films(wanted, known, items).collect()] == [1, 1, 1]


def test_dataset_of_users_without_a_retrieved_positive(spark):
    rows = [(u, f, "both", f, f, f) for u in (1, 2) for f in (1, 2, 3)]
    candidates = spark.createDataFrame(rows, "user_id long, film_id long, membership string, svd_rank long, popularity_rank long, rrf_rank long")
    examples = spark.createDataFrame([(1, 2, "positive", 3), (2, 99, "positive", 1), (1, 3, "forbidden", None)], "user_id long, film_id long, kind string, label int")
    train = {(r.user_id, r.film_id): r.label for r in training.partition_dataset(candidates, examples, 10).collect()}
    test = {(r.user_id, r.film_id): r.label for r in training.partition_dataset(candidates, examples).collect()}
    assert train == {(1, 1): 0, (1, 2): 3}
    assert test == {(1, 1): 0, (1, 2): 3, (2, 1): 0, (2, 2): 0, (2, 3): 0}


def test_reason_without_a_source(spark):
    rows = spark.createDataFrame([("both", "HEAD"), ("svd_only", None)], "membership string, stratum string")
    got = [r.r for r in rows.select(reasons.candidate("X").alias("r")).collect()]
    assert [(list(r.additional_codes), r.retrieved_by_both) for r in got] == [(["SOURCE_AGREEMENT"], True), ([], False)]


def test_first_terminal_state_stays(spark):
    events = spark.createDataFrame([(1, 1, "queued"), (2, 1, "done"), (3, 1, "failed"), (4, 2, "queued"), (5, 2, "running")], "event_id long, user_id long, event_type string")
    got = {r.user_id: (r.state, r.terminal, r.n) for r in jobs.task_states(events, ["done", "failed"]).collect()}
    assert got == {1: ("done", True, 3), 2: ("running", False, 2)}


def test_upsert_goes_on_after_a_restart(spark, tmp_path):
    source, place = tmp_path / "rows", work.folder(spark)

    def put(rows, part):
        spark.createDataFrame(rows, "id long, value string, seq long").write.mode("append").parquet(str(source))
        return {r.id: r.value for r in jobs.upsert_stream(spark, str(source), ["id"], "value", "seq", place).collect()}

    assert put([(1, "a", 1), (2, "b", 1)], 0) == {1: "a", 2: "b"}
    assert put([(1, "c", 2), (2, "x", 0), (3, "d", 1)], 1) == {1: "c", 2: "b", 3: "d"}


def test_sync_requests_match_a_plain_loop(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, i % 3, start + datetime.timedelta(seconds=137 * i), i % 11 == 0, i % 5 == 0) for i in range(120)]
    frame = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, forced boolean, failed boolean")
    frame.coalesce(1).write.parquet(str(tmp_path / "requests"))
    got = {r.event_id: r.reused for r in jobs.drained(spark, str(tmp_path / "requests"), jobs.sync_requests, "append").collect()}
    last, want = {}, {}
    for event, user, at, forced, failed in rows:
        want[event] = not forced and user in last and (at - last[user]).total_seconds() <= 900
        if not want[event] and not failed:
            last[user] = at
    assert got == want and True in got.values()
