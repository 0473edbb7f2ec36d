"""Queries of stream jobs over tables that arrive piece by piece; each piece is one run, which goes on from the run before it."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.plans.registry import query
from marquee.sources.bridge import derived, oracle, read
from marquee.sources.work import folder, saved
from marquee.streaming import watch

_FIRST_RUN, _RUN_DAYS = datetime(2024, 1, 1), 100


def arriving(rows: DataFrame, pieces: int, path: str) -> Iterator[int]:
    """Appends the rows of piece 0, 1, ... to the folder at path and yields after each."""
    rows = saved(rows)
    for k in range(pieces):
        rows.where(F.col("piece") == k).drop("piece").write.mode("append").parquet(path)
        yield k


@query("stream_retrain", oracle("""WITH RECURSIVE p AS (SELECT user_id, film_id, seq * 4 // (SELECT max(seq) + 1 FROM raw_logs) AS piece FROM raw_logs WHERE rating IS NOT NULL),
    k AS (SELECT run, (SELECT count(DISTINCT user_id) FROM p WHERE piece <= run) AS u, (SELECT count(DISTINCT film_id) FROM p WHERE piece <= run) AS f, (SELECT count(*) FROM (SELECT DISTINCT user_id, film_id FROM p WHERE piece <= run)) AS i FROM range(4) r(run)),
    t AS (SELECT -1::BIGINT AS run, 0::BIGINT AS ud, 0::BIGINT AS id, 0::BIGINT AS nf, 0::DOUBLE AS age, '' AS reasons, 0::BIGINT AS u, 0::BIGINT AS f, 0::BIGINT AS i, NULL::BIGINT AS tu, NULL::BIGINT AS tf, NULL::BIGINT AS ti, NULL::BIGINT AS made
     UNION ALL SELECT run, ud, id, nf, age, concat_ws(',', CASE WHEN ud >= 100 THEN 'users' END, CASE WHEN nf >= 250 THEN 'films' END, CASE WHEN made IS NOT NULL AND age >= 180 THEN 'age' END), u, f, i, tu, tf, ti, made
     FROM (SELECT k.run, k.u, k.f, k.i, greatest(0, k.u - coalesce(b.tu, 0)) AS ud, k.i - coalesce(b.ti, 0) AS id, greatest(0, k.f - coalesce(b.tf, 0)) AS nf, coalesce((k.run - b.made) * 100.0, 0)::DOUBLE AS age, b.tu, b.tf, b.ti, b.made
      FROM (SELECT run, CASE WHEN reasons <> '' THEN u ELSE tu END AS tu, CASE WHEN reasons <> '' THEN f ELSE tf END AS tf, CASE WHEN reasons <> '' THEN i ELSE ti END AS ti, CASE WHEN reasons <> '' THEN run ELSE made END AS made FROM t) b JOIN k ON k.run = b.run + 1))
    SELECT run, ud AS user_delta, id AS interaction_delta, nf AS new_films, age AS age_days, reasons FROM t WHERE run >= 0""").replace("WITH raw_logs", "WITH RECURSIVE raw_logs").replace(", RECURSIVE p AS", ", p AS"))
def stream_retrain(spark, sf_dir):
    """Ratings come in four pieces, 100 days apart; the decision of each run, after which a model is trained where one is due."""
    logs = derived(spark, sf_dir, "raw_logs")
    end = logs.agg((F.max("seq") + 1).alias("end"))
    rows = logs.crossJoin(F.broadcast(end)).select("user_id", "film_id", "rating", F.expr("CAST(seq * 4 div end AS INT)").alias("piece"))  # end is one row
    path, work, out = folder(spark), folder(spark), []
    for k in arriving(rows, 4, path):
        now = _FIRST_RUN + timedelta(days=_RUN_DAYS * k)
        row = watch.retrain_trigger(spark, path, work, now).first()
        if row.reasons:
            watch.mark_trained(spark, work, now)
        out.append((k, row.user_delta, row.interaction_delta, row.new_films, row.age_days, ",".join(row.reasons)))
    return spark.createDataFrame(out, "run bigint, user_delta bigint, interaction_delta bigint, new_films bigint, age_days double, reasons string")


@query("stream_pending_arrivals", """WITH p AS (SELECT * FROM events WHERE event_type = 'view'), a AS (SELECT * FROM events WHERE event_type = 'purchase'),
    j AS (SELECT p.event_id, p.user_id AS slug, a.event_id AS film_id, p.ts FROM p LEFT JOIN a ON a.user_id = p.user_id AND a.ts BETWEEN p.ts AND p.ts + INTERVAL 2 DAY),
    w AS (SELECT least((SELECT max(ts) FROM p), (SELECT max(ts) FROM a)) - INTERVAL 2 DAY AS mark)
    SELECT event_id, slug, film_id, CASE WHEN film_id IS NOT NULL THEN 'matched' WHEN ts + INTERVAL 2 DAY < mark THEN 'expired' ELSE 'waiting' END AS outcome FROM j, w""")
def stream_pending_arrivals(spark, sf_dir):
    """Views wait two days for a purchase of their user, both arriving in three pieces: matched, expired by the watermark, or still waiting."""
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    end = events.agg((F.max("event_id") + 1).alias("end"))
    rows = saved(events.crossJoin(F.broadcast(end)).withColumn("piece", F.expr("CAST(event_id * 3 div end AS INT)")))  # end is one row
    pending = rows.where("event_type = 'view'").select("event_id", F.col("user_id").alias("slug"), "ts", "piece")
    arrivals = rows.where("event_type = 'purchase'").select(F.col("user_id").alias("slug"), F.col("ts").alias("arrived_at"), F.col("event_id").alias("film_id"), "piece")
    path, other, work = folder(spark), folder(spark), folder(spark)
    out = None
    for _ in zip(arriving(pending, 3, path), arriving(arrivals, 3, other), strict=True):
        out = watch.pending_stream(spark, path, other, "2 days", work).select("event_id", "slug", "film_id")
    out = out.withColumn("outcome", F.when(F.col("film_id").isNotNull(), "matched").otherwise("expired"))
    waiting = spark.read.parquet(path).select("event_id", "slug", F.lit(None).cast("bigint").alias("film_id"), F.lit("waiting").alias("outcome"))
    return out.unionByName(waiting.join(out.select("event_id").distinct(), "event_id", "left_anti").select(*out.columns))


@query("stream_late_upserts", """WITH m AS (SELECT max(event_id) + 1 AS n FROM events), e AS (SELECT user_id, value, ts, event_id, event_id * 5 // n + (event_id % 7 = 0)::INT AS piece FROM events, m),
    w AS (SELECT piece, max(max(ts)) OVER (ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAY AS mark FROM e GROUP BY piece)
    SELECT user_id, max_by(value, ts) FILTER (NOT late) AS value, count(*) FILTER (late) AS late_rows FROM (SELECT e.*, coalesce(ts < mark, false) AS late FROM e JOIN w USING (piece)) GROUP BY user_id""")
def stream_late_upserts(spark, sf_dir):
    """Every seventh event comes a piece late; those over two days behind are kept aside, the others still count by their own time."""
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    end = events.agg((F.max("event_id") + 1).alias("end"))
    piece = F.expr("CAST(event_id * 5 div end + IF(event_id % 7 = 0, 1, 0) AS INT)")
    rows = events.crossJoin(F.broadcast(end)).select("event_id", "user_id", "ts", "value", piece.alias("piece"))  # end is one row
    path, work = folder(spark), folder(spark)
    for _ in arriving(rows, 6, path):
        table, late, progress = watch.late_upserts(spark, path, work, ["user_id"], "value", "ts", "event_id", 2 * 86_400)
    if progress.agg(F.sum("late")).first()[0] != late.count():
        raise ValueError("the observed number of late rows isn't that of the rows kept aside")
    counts = late.groupBy("user_id").agg(F.count("*").alias("late_rows"))
    return table.join(counts, "user_id", "full").select("user_id", "value", F.coalesce("late_rows", F.lit(0)).cast("bigint").alias("late_rows"))


@query("stream_rolling_top", "SELECT start, user_id, n, place FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY n DESC, user_id) AS place FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) - to_days(CAST(k AS INT)) AS start, user_id, count(*) AS n FROM events, range(7) r(k) WHERE value >= 50 GROUP BY 1, 2)) WHERE place <= 5")
def stream_rolling_top(spark, sf_dir):
    """The five users with the most events of 50 and over in every week, a week beginning each day; every fifth event comes two pieces late."""
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    end = events.agg((F.max("event_id") + 1).alias("end"))
    piece = F.expr("CAST(least(3, event_id * 4 div end + IF(event_id % 5 = 0, 2, 0)) AS INT)")
    rows = events.crossJoin(F.broadcast(end)).select("user_id", "ts", "value", piece.alias("piece"))  # end is one row
    path, work, out = folder(spark), folder(spark), None
    for _ in arriving(rows, 4, path):
        out = watch.rolling_top_stream(spark, path, work, "user_id", F.col("value") >= 50, "7 days", "1 day", 5)
    return out
