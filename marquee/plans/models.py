"""Queries of the model's life: runs that decide, build, validate and promote."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marquee.plans.registry import query
from marquee.sources.bridge import derived, oracle
from marquee.sources.models import ModelStore, svd_and_popularity
from marquee.sources.work import folder, saved

_FIRST_RUN, _RUN_DAYS = datetime(2024, 1, 1), 100
#: Per cent of the range of user ids that have joined by each run.
_JOINED = (60, 62, 95, 97, 100)


@query("model_runs", oracle(f"""WITH RECURSIVE at_run AS (SELECT unnest(range({len(_JOINED)})) AS run, unnest([{', '.join(map(str, _JOINED))}]) AS joined),
    p AS (SELECT run, user_id, film_id, rating FROM logs, (SELECT max(user_id) + 1 AS m FROM logs), at_run WHERE rating IS NOT NULL AND user_id * 100 // m < joined),
    k AS (SELECT run, count(DISTINCT user_id) AS u, count(DISTINCT film_id) AS f, count(*) AS i FROM p GROUP BY run),
    b AS (SELECT run, film_id AS top_film FROM (SELECT run, film_id, row_number() OVER (PARTITION BY run ORDER BY count(*) FILTER (rating >= 3.5) DESC, film_id) AS place FROM p GROUP BY run, film_id) WHERE place = 1),
    t AS (SELECT -1::BIGINT AS run, 0::BIGINT AS ud, 0::BIGINT AS id, 0::BIGINT AS nf, 0::DOUBLE AS age, '' AS reasons, NULL::BIGINT AS made, 0::BIGINT AS version
     UNION ALL SELECT run, ud, id, nf, age, why, CASE WHEN why <> '' THEN run ELSE made END, version + CAST(why <> '' AS INT)
     FROM (SELECT *, concat_ws(',', CASE WHEN ud >= 100 THEN 'users' END, CASE WHEN nf >= 250 THEN 'films' END, CASE WHEN made IS NOT NULL AND age >= 180 THEN 'age' END) AS why
      FROM (SELECT k.run, greatest(0, k.u - coalesce(o.u, 0)) AS ud, k.i - coalesce(o.i, 0) AS id, k.f - coalesce(o.f, 0) AS nf, coalesce((k.run - made) * {_RUN_DAYS}.0, 0)::DOUBLE AS age, made, version FROM t JOIN k ON k.run = t.run + 1 LEFT JOIN k o ON o.run = t.made)))
    SELECT t.run, ud AS user_delta, id AS interaction_delta, nf AS new_films, age AS age_days, reasons, CASE WHEN reasons <> '' THEN 'promoted' ELSE 'not due' END AS outcome, nullif(version, 0) AS version, k.u AS users, k.i AS interactions, k.f AS films, k.f AS with_vector, top_film
    FROM t LEFT JOIN k ON k.run = made LEFT JOIN b ON b.run = made WHERE t.run >= 0""").replace("WITH logs", "WITH RECURSIVE logs").replace(", RECURSIVE at_run", ", at_run"))
def model_runs(spark, sf_dir):
    """Users join from run to run, 100 days apart: each run's decision, and what the version served after it was trained on."""
    logs = saved(derived(spark, sf_dir, "logs"))
    end = logs.agg((F.max("user_id") + 1).alias("end"))
    joined = logs.crossJoin(F.broadcast(end)).withColumn("percent", F.expr("user_id * 100 div end"))  # one row
    store, out = ModelStore(spark, folder(spark)), []
    for run, percent in enumerate(_JOINED):
        got = store.retrain(joined.where(F.col("percent") < percent).select("user_id", "film_id", "rating"), _FIRST_RUN + timedelta(days=_RUN_DAYS * run), build=svd_and_popularity(16))
        served = got["version"]
        m = store.manifest(served) if served else dict.fromkeys(("users", "interactions", "films"))
        with_vector = store.vectors(served).count() if served else None
        top = store.popularity(served).where("popularity_rank = 1").first().film_id if served else None
        out.append((run, got["user_delta"], got["interaction_delta"], got["new_films"], got["age_days"], ",".join(got["reasons"]), got["outcome"], served, m["users"], m["interactions"], m["films"], with_vector, top))
    return spark.createDataFrame(out, "run bigint, user_delta bigint, interaction_delta bigint, new_films bigint, age_days double, reasons string, outcome string, version bigint, users bigint, interactions bigint, films bigint, with_vector bigint, top_film bigint")
