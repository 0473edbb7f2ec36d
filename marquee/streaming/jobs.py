"""Structured Streaming jobs; each transformation also works on a batch of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.sources.work import folder, versions
from marquee.streaming.keyed import KeyedTable, last_by


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """start, end, event_type, n, total over tumbling or sliding windows of ts."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """user_id, start, end, n of each user's runs of events with less than gap between them."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest_state(events: DataFrame) -> DataFrame:
    """user_id, state (type of the last event by event_id), n."""
    return events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("state"), F.count("*").alias("n"))


def fresh(events: DataFrame, keys: list[str], within: str) -> DataFrame:
    """The first event of a key; later ones within the time count as covered by it."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def pending_matches(pending: DataFrame, arrivals: DataFrame, wait: str) -> DataFrame:
    """pending(slug, ts, ...) with arrivals(slug, arrived_at, film_id) up to wait later; unmatched rows come out after the watermark."""
    p, a = pending.withWatermark("ts", wait), arrivals.withWatermark("arrived_at", wait)
    return p.join(a.withColumnRenamed("slug", "slug2"), F.expr(f"slug = slug2 AND arrived_at BETWEEN ts AND ts + INTERVAL {wait}"), "leftOuter").drop("slug2")


def rolling_top(events: DataFrame, item: str, positive: Column, length: str, slide: str, k: int, late: str = "1 day") -> DataFrame:
    """start, item, n, place: each window's k items with the most positive events. A stream calls it on batches (foreachBatch)."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counts = rows.where(positive).groupBy(F.window("ts", length, slide).alias("w"), item).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("start").orderBy(F.col("n").desc(), item))
    return counts.select(F.col("w.start").alias("start"), item, "n").withColumn("place", place).where(F.col("place") <= k)


def task_states(events: DataFrame, terminal: list[str]) -> DataFrame:
    """user_id, state, terminal, n of tasks: the first terminal state by event_id if any, which later events don't change, else the last state."""
    final = F.col("event_type").isin(*terminal)
    first = F.min_by(F.when(final, F.col("event_type")), F.when(final, F.col("event_id")))
    out = events.groupBy("user_id").agg(first.alias("f"), F.max_by("event_type", "event_id").alias("l"), F.count("*").alias("n"))
    return out.select("user_id", F.coalesce("f", "l").alias("state"), F.col("f").isNotNull().alias("terminal"), "n")


def sync_requests(events: DataFrame, within: int = 900) -> DataFrame:
    """event_id, user_id, reused of a stream or table of requests(event_id, user_id, ts, forced, failed), in order of (ts, event_id).

    A request is reused if it isn't forced and the user's last run that didn't fail began at most within seconds before. Runs that
    failed are never reused. The state is one time a user; a user's requests of one batch are ordered before they are judged.
    """

    def judge(key, frames, state):
        import pandas as pd

        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for event, at, forced, failed in zip(rows["event_id"], rows["ts"], rows["forced"], rows["failed"], strict=True):
            reused = bool(not forced and last is not None and at - last <= within * 10**6)
            if not reused and not failed:
                last = int(at)
            out.append((event, key[0], reused))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "reused"])

    rows = events.select("event_id", "user_id", F.unix_micros("ts").alias("ts"), "forced", "failed")
    return rows.groupBy("user_id").applyInPandasWithState(judge, "event_id bigint, user_id bigint, reused boolean", "last bigint", "append", "NoTimeout")


def _source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files at path, a folder or one file (as a pattern, which streams take for either); times become instants."""
    head, _, name = path.rpartition("/")
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{head}/{name[:-1]}[{name[-1]}]")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, t in rows.dtypes if t == "timestamp_ntz"})


def drained(spark: SparkSession, path: str, job: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Runs a job over all that is at path now and returns its rows: of a complete result its last version.

    A batch is a table named by its number, so one that comes again replaces itself.
    """
    out, check = folder(spark), folder(spark)
    frame = job(_source(spark, path))

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/{batch}")

    frame.writeStream.outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    done = versions(spark, out)
    if not done:
        return spark.createDataFrame([], frame.schema)
    return spark.read.schema(frame.schema).parquet(*(f"{out}/{n}" for n in (done[-1:] if mode == "complete" else done)))


def upsert_stream(spark: SparkSession, path: str, keys: list[str], value: str, order: str, work: str | None = None, buckets: int = 32) -> DataFrame:
    """keys and value of the last row by order, kept in a keyed table of which a batch rewrites the buckets of its keys only.

    A batch that comes again starts from the table before it and changes nothing. work: the folder of an earlier run to go on from;
    table and checkpoint lie there, nothing is kept in the driver.
    """
    work = work or folder(spark)
    source = _source(spark, path).select(*keys, value, order)
    table = KeyedTable(spark, f"{work}/table", keys, source.schema, buckets)

    def put(rows: DataFrame, batch: int) -> None:
        table.merge(rows, batch, last_by(keys, [value], [order]))

    source.writeStream.option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return table.read().drop(order)
