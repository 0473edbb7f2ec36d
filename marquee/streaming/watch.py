"""Jobs that run over what has arrived since their last run: retraining decisions, pending rows and late rows.

Each takes a work folder that holds its checkpoint, state and results; a run reads new files only and may be repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from marquee.operators.evaluation import retraining_reasons
from marquee.sources.work import versions
from marquee.streaming.jobs import _source, pending_matches
from marquee.streaming.keyed import BUCKET, KeyedTable, last_by


def _run(frame: DataFrame, work: str, put: Callable[[DataFrame, int], None]) -> None:
    """Runs a stream over all that is there now, through put(rows, batch)."""
    frame.writeStream.option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def _note(spark: SparkSession, path: str, number: int, row: dict, schema: str) -> None:
    """Writes a table of one row under its number."""
    spark.createDataFrame([tuple(row.values())], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{number}")


def _noted(spark: SparkSession, path: str, below: int | None = None) -> dict | None:
    """The last row that _note() wrote, below a number if given."""
    done = [n for n in versions(spark, path) if below is None or n < below]
    return spark.read.parquet(f"{path}/{done[-1]}").first().asDict() if done else None


_COUNTS = "users bigint, films bigint, interactions bigint"


def _keys(rows: DataFrame) -> DataFrame:
    """kind, a, b: the users, films and pairs of rated rows(user_id, film_id, rating)."""
    rated = rows.where("rating IS NOT NULL AND user_id IS NOT NULL AND film_id IS NOT NULL").select(F.col("user_id").cast("bigint").alias("u"), F.col("film_id").cast("bigint").alias("f")).distinct()
    key = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    none = F.lit(None).cast("bigint")
    return rated.select(F.inline(F.array(key("user", F.col("u"), none), key("film", F.col("f"), none), key("pair", F.col("u"), F.col("f"))))).distinct()


def training_counts(spark: SparkSession, path: str, work: str, buckets: int = 32) -> dict:
    """users, films and interactions (distinct pairs) of all rated rows(user_id, film_id, rating) at path up to now.

    Users, films and pairs seen are a keyed table with the batch that brought them first. A batch looks only into the buckets of its
    own keys and adds what is new to the counts of the batch before it; nothing that an earlier run counted is read again.
    """
    source = _source(spark, path).select("user_id", "film_id", "rating")
    schema = spark.createDataFrame([], "kind string, a bigint, b bigint, first bigint").schema
    table = KeyedTable(spark, f"{work}/keys", ["kind", "a", "b"], schema, buckets)

    def put(rows: DataFrame, batch: int) -> None:
        fold = lambda both: both.groupBy(BUCKET, "kind", "a", "b").agg(F.min("first").alias("first"))
        table.merge(_keys(rows).withColumn("first", F.lit(batch).cast("bigint")), batch, fold)
        new = {r.kind: r["count"] for r in table.written(batch).where(F.col("first") == batch).groupBy("kind").count().collect()}  # three rows
        before = _noted(spark, f"{work}/counts", batch) or dict.fromkeys(("users", "films", "interactions"), 0)
        counts = {c: before[c] + new.get(kind, 0) for c, kind in (("users", "user"), ("films", "film"), ("interactions", "pair"))}
        _note(spark, f"{work}/counts", batch, counts, _COUNTS)

    _run(source, work, put)
    return _noted(spark, f"{work}/counts") or dict.fromkeys(("users", "films", "interactions"), 0)


def mark_trained(spark: SparkSession, work: str, at: datetime, counts: dict | None = None) -> None:
    """Notes that a model was trained at a time, on what the last run counted if counts aren't given (-1: unknown)."""
    done = versions(spark, f"{work}/trained")
    _note(spark, f"{work}/trained", done[-1] + 1 if done else 0, {**(counts or _noted(spark, f"{work}/counts")), "at": at}, f"{_COUNTS}, at timestamp")


def retrain_trigger(spark: SparkSession, path: str, work: str, now: datetime, forced: bool = False, users: int = 100, films: int = 250, days: int = 180) -> DataFrame:
    """One row: user_delta, interaction_delta, new_films, age_days, reasons (empty: no retraining) of a run at a time.

    The model that was trained last is the one that mark_trained() noted. A film that was counted then is one of its films: the sets
    of seen users, films and pairs only grow, so that differences of counts are numbers of new ones.
    """
    counts, trained = training_counts(spark, path, work), _noted(spark, f"{work}/trained")
    age = (now - trained["at"]).total_seconds() / 86400 if trained else 0.0
    unknown = bool(trained) and min(trained["users"], trained["interactions"]) < 0
    delta = {c: counts[c] - (trained[c] if trained else 0) if not trained or trained[c] >= 0 else 0 for c in ("users", "interactions", "films")}
    row = (max(0, delta["users"]), delta["interactions"], max(0, delta["films"]), max(0.0, age), unknown, bool(trained))
    rows = spark.createDataFrame([row], "user_delta bigint, interaction_delta bigint, new_films bigint, age_days double, unknown boolean, model boolean")
    return retraining_reasons(rows, forced, users, films, days)


def pending_stream(spark: SparkSession, pending: str, arrivals: str, wait: str, work: str) -> DataFrame:
    """pending(event_id, slug, ts) joined with arrivals(slug, arrived_at, film_id) as both come in: all rows given out up to now.

    A pending row comes out with every arrival up to wait later, or once without one when both watermarks, wait behind the latest
    rows of either side, have passed the end of its time. Till then it is state of the join, which later runs go on with.
    """
    frame = pending_matches(_source(spark, pending), _source(spark, arrivals), wait)

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{work}/out/{batch}")

    _run(frame, work, put)
    done = versions(spark, f"{work}/out")
    return spark.read.schema(frame.schema).parquet(*(f"{work}/out/{n}" for n in done)) if done else spark.createDataFrame([], frame.schema)


def late_upserts(spark: SparkSession, path: str, work: str, keys: list[str], value: str, time: str, order: str, delay_seconds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table, late rows, progress) of a stream of rows(keys, value, time, order) that may come out of order.

    The table holds the value of each key's last row by (time, order), whatever the order of arrival. Rows more than the delay
    behind the latest time of earlier batches are late: they are counted, kept aside and leave the table alone. Both kinds are
    written in one scan, which is also observed for the counts. progress: batch, seen, late, latest.
    """
    source = _source(spark, path)
    table = KeyedTable(spark, f"{work}/table", keys, source.select(*keys, value, time, order).schema)

    def put(rows: DataFrame, batch: int) -> None:
        before = _noted(spark, f"{work}/progress", batch)
        behind = F.lit(False) if not before or before["latest"] is None else F.col(time) < F.lit(before["latest"]) - F.make_interval(secs=F.lit(delay_seconds))
        seen = Observation(f"rows_of_{batch}")
        marked = rows.withColumn("__late", F.coalesce(behind, F.lit(False)))
        marked.observe(seen, F.count("*").alias("seen"), F.count_if("__late").alias("late"), F.max(time).alias("latest")).write.mode("overwrite").partitionBy("__late").parquet(f"{work}/rows/{batch}")
        parts = spark.read.schema(marked.schema).parquet(f"{work}/rows/{batch}")
        table.merge(parts.where("NOT __late"), batch, last_by(keys, [value], [time, order]))
        got = seen.get
        latest = max((t for t in (got["latest"], before and before["latest"]) if t is not None), default=None)
        _note(spark, f"{work}/progress", batch, {"batch": batch, "seen": got["seen"], "late": got["late"], "latest": latest}, "batch bigint, seen bigint, late bigint, latest timestamp")

    _run(source, work, put)
    done = versions(spark, f"{work}/progress")
    if not done:
        return table.read(), spark.createDataFrame([], source.schema), spark.createDataFrame([], "batch bigint, seen bigint, late bigint, latest timestamp")
    whole = spark.read.schema(source.schema.add("__late", "boolean"))
    late = [whole.option("basePath", f"{work}/rows/{n}").parquet(f"{work}/rows/{n}").where("__late").drop("__late") for n in done]
    kept = late[0]
    for part in late[1:]:
        kept = kept.unionByName(part)
    return table.read(), kept, spark.read.parquet(*(f"{work}/progress/{n}" for n in done))


def rolling_top_stream(spark: SparkSession, path: str, work: str, item: str, positive: Column, length: str, slide: str, k: int, buckets: int = 32) -> DataFrame:
    """start, item, n, place: each window's k items with the most positive rows(ts, item, ...) of all that came up to now.

    Counts are a keyed table by window and item, so that a window of many items lies in many buckets. A batch adds to the buckets
    of its keys and keeps each such bucket's k best items of every window; a window's k best are among these, at most k times
    buckets. Rows count whenever they come; a row without a time is in no window.
    """
    source = _source(spark, path)
    opened = source.where(positive).select(F.window("ts", length, slide).alias("w"), item)
    schema = opened.select(F.col("w.start").alias("start"), item, F.lit(0).cast("bigint").alias("n")).schema
    counts = KeyedTable(spark, f"{work}/counts", ["start", item], schema, buckets)
    best = KeyedTable(spark, f"{work}/best", ["part"], spark.createDataFrame([], schema).select(F.lit(0).alias("part"), "*", F.lit(0).cast("bigint").alias("batch")).schema, buckets)
    by = [F.col("n").desc(), item]

    def newest(both: DataFrame) -> DataFrame:
        last = F.max("batch").over(Window.partitionBy(BUCKET, "part"))
        return both.withColumn("__last", last).where("batch = __last").drop("__last")

    def put(rows: DataFrame, batch: int) -> None:
        new = rows.groupBy("w", item).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), item, "n")
        counts.merge(new, batch, lambda both: both.groupBy(BUCKET, "start", item).agg(F.sum("n").alias("n")))
        place = F.row_number().over(Window.partitionBy("part", "start").orderBy(*by))
        top = counts.written(batch).withColumn("part", counts.bucket()).withColumn("place", place).where(F.col("place") <= k)
        best.merge(top.withColumn("batch", F.lit(batch).cast("bigint")), batch, newest)

    _run(opened, work, put)
    place = F.row_number().over(Window.partitionBy("start").orderBy(*by))
    return best.read().select("start", item, "n").withColumn("place", place).where(F.col("place") <= k)
