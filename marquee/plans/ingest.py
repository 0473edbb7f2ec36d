"""Queries of cleaning, deduplication, identity resolution and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions import cleaning as C
from marquee.functions.reasons import NO_USABLE, NO_WATCHED
from marquee.operators import identity, quality
from marquee.plans.core import sql
from marquee.plans.registry import query
from marquee.sources.bridge import derived, oracle, read
from marquee.streaming import jobs


@query("clean_scalars", oracle("""SELECT p_partkey, nullif(trim(p_name || '  '), '') AS name, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS size, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS DOUBLE) + 0.5 END AS price, CAST(floor((1900 + p_size) / 10) * 10 AS BIGINT) AS decade,
    CAST(CAST(floor((1900 + p_size) / 10) * 10 AS BIGINT) AS VARCHAR) || 's' AS label, lower(regexp_replace(p_name, ' +', ' ', 'g')) AS key, CASE WHEN p_size <= 10 THEN p_size / 2.0::DOUBLE END AS rating, CASE WHEN p_size < 10 THEN 'FILTERED' ELSE 'SUCCESS' END AS outcome, CASE WHEN p_size <= 5 THEN CAST(p_size AS DOUBLE) END AS average FROM part"""))
def clean_scalars(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    text = F.when(F.col("p_partkey") % 4 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5 ")))
    size = F.col("p_size").cast("string")
    return p.select("p_partkey", C.safe_string(F.concat("p_name", F.lit("  "))).alias("name"), C.safe_int(text).cast("int").alias("size"), C.safe_double(text).alias("price"), C.decade(1900 + F.col("p_size")).alias("decade"), C.decade_label(1900 + F.col("p_size")).alias("label"),
                    C.title_key(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("   ")))).alias("key"), C.parse_rating((F.col("p_size") / 2).cast("string")).alias("rating"), C.admission(F.col("p_name"), F.col("p_partkey"), F.col("p_size"), 10).alias("outcome"), C.valid_average(size.cast("double")).alias("average"))


@query("clean_lists", oracle("SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x <> ''), '|') AS names FROM part"))
def clean_lists(spark, sf_dir):
    text = F.concat(F.lit("['"), F.replace("p_name", F.lit(" "), F.lit(" ', ' ")), F.lit("', '  ']"))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(C.parse_list(text), "|").alias("names"))


@query("clean_lists_exact", oracle("SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x <> ''), '|') AS names FROM part"))
def clean_lists_exact(spark, sf_dir):
    text = F.concat(F.lit("['"), F.replace("p_name", F.lit(" "), F.lit(" ', ' ")), F.lit("', 7, None]"))
    rows = read(spark, sf_dir, "part").select("p_partkey", text.alias("raw"))
    return C.parse_list_exact(rows, "raw", "names").select("p_partkey", F.array_join("names", "|").alias("names"))


@query("first_row_wins", oracle("SELECT user_id, film_id, rating FROM (SELECT *, row_number() OVER (PARTITION BY user_id, film_id ORDER BY seq, source, price) AS rn FROM raw_logs) WHERE rn = 1"))
def first_row_wins(spark, sf_dir):
    return quality.first_by(derived(spark, sf_dir, "raw_logs"), ["user_id", "film_id"], ["seq", "source", "price"]).select("user_id", "film_id", "rating")


@query("conflicting_rows", oracle("SELECT user_id, film_id, min(rating) AS rating, count(*) - 1 AS duplicates, min(rating) <> max(rating) AS conflict FROM raw_logs GROUP BY user_id, film_id"))
def conflicting_rows(spark, sf_dir):
    return quality.conflict_checked(derived(spark, sf_dir, "raw_logs"), ["user_id", "film_id"], "rating", strict=False)


@query("last_write_wins", oracle("SELECT user_id, film_id, max_by(rating, seq * 1000000 + source * 100 + rating) AS rating FROM raw_logs GROUP BY user_id, film_id"))
def last_write_wins(spark, sf_dir):
    rows = derived(spark, sf_dir, "raw_logs").withColumn("o", F.col("seq") * 1000000 + F.col("source") * 100 + F.col("rating"))
    return quality.last_write(rows, ["user_id", "film_id"], "rating", "o")


@query("uniqueness_audit", oracle("SELECT user_id, film_id, count(*) AS n FROM raw_logs GROUP BY user_id, film_id HAVING count(*) > 1"))
def uniqueness_audit(spark, sf_dir):
    return quality.duplicates(derived(spark, sf_dir, "raw_logs"), ["user_id", "film_id"])


@query("stride_sample", oracle("SELECT user_id, number FROM (SELECT user_id, row_number() OVER (ORDER BY user_id) AS number FROM (SELECT DISTINCT user_id FROM logs)) WHERE (number - 1) % 25 = 0"))
def stride_sample(spark, sf_dir):
    users = derived(spark, sf_dir, "logs").select("user_id").distinct()
    return quality.stride(quality.numbered(users, "user_id"), "user_id", 25)


@query("oldest_pending", oracle("SELECT o_orderkey AS id, o_orderdate AS created_at, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'P' ORDER BY created_at, id LIMIT 50"))
def oldest_pending(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))
    return quality.oldest(rows, "P", 50)


@query("user_history", oracle("SELECT c_custkey AS user_id, count(film_id) AS watched, count(rating) AS rated FROM customer LEFT JOIN logs ON c_custkey = user_id GROUP BY c_custkey"))
def user_history(spark, sf_dir):
    users = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return users.join(derived(spark, sf_dir, "logs"), "user_id", "left").groupBy("user_id").agg(F.count("film_id").alias("watched"), F.count("rating").alias("rated"))


@query("recommendation_status", oracle(f"""SELECT user_id, watched, rated, usable, CASE WHEN watched = 0 THEN '{NO_WATCHED}' WHEN usable = 0 THEN '{NO_USABLE}' END AS info
    FROM (SELECT c_custkey AS user_id, count(l.film_id) AS watched, count(rating) AS rated, count(rating) FILTER (i.film_id IS NOT NULL) AS usable FROM customer LEFT JOIN logs l ON c_custkey = user_id LEFT JOIN (SELECT film_id FROM item_vectors) i ON i.film_id = l.film_id GROUP BY c_custkey)"""))
def recommendation_status(spark, sf_dir):
    """What every customer's history allows, unknown to the logs or not."""
    users = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return identity.histories(users, derived(spark, sf_dir, "logs"), derived(spark, sf_dir, "item_vectors"))


@query("catalog_snapshot", oracle("SELECT film_id, family, string_agg(CAST(entity_id AS VARCHAR), ',' ORDER BY entity_id) AS ids FROM (SELECT DISTINCT film_id, family, entity_id FROM film_entity WHERE film_id IN (SELECT film_id FROM item_vectors)) GROUP BY film_id, family"))
def catalog_snapshot(spark, sf_dir):
    rows = derived(spark, sf_dir, "film_entity").join(derived(spark, sf_dir, "item_vectors"), "film_id", "left_semi")
    return rows.groupBy("film_id", "family").agg(F.array_join(F.array_sort(F.collect_set("entity_id")), ",").alias("ids"))


@query("slug_resolution", oracle("SELECT count(*) AS rows_, count(p_partkey) AS resolved, count(*) FILTER (p_partkey IS NULL) AS unresolved FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0) ON l_partkey = p_partkey"))
def slug_resolution(spark, sf_dir):
    films = read(spark, sf_dir, "part").where("p_partkey % 10 <> 0").select(F.concat(F.lit("film-"), "p_partkey").alias("slug"), F.col("p_partkey").alias("film_id"))
    rows = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("film-"), "l_partkey").alias("slug"))
    return identity.resolution_counts(identity.resolve(rows, films, "slug"), "film_id")


@query("new_identities", oracle("SELECT name, (SELECT max(n_nationkey) + 100 FROM nation) + row_number() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT c_name AS name FROM customer)"))
def new_identities(spark, sf_dir):
    known = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") + 100).cast("bigint").alias("id"))
    return identity.new_identities(read(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), known)


@query("title_resolution", oracle("""WITH e AS (SELECT p_partkey AS entry_id, p_name AS k, 1900 + p_size % 7 AS y FROM part), f AS (SELECT p_partkey AS film_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'other' END AS a, p_name AS b, 1900 + p_size % 7 AS y FROM part WHERE p_partkey % 3 = 0),
    x AS (SELECT entry_id, min(film_id) AS m, count(DISTINCT film_id) AS n FROM e JOIN f ON e.k = f.a AND e.y = f.y GROUP BY entry_id), z AS (SELECT entry_id, min(film_id) AS m, count(DISTINCT film_id) AS n FROM e JOIN f ON e.k = f.b AND e.y = f.y GROUP BY entry_id)
    SELECT e.entry_id, CASE WHEN coalesce(x.n, z.n, 0) = 1 THEN coalesce(x.m, z.m) END AS film_id, CASE WHEN coalesce(x.n, z.n, 0) = 1 THEN 'resolved' WHEN coalesce(x.n, z.n, 0) > 1 THEN 'ambiguous' ELSE 'not_found' END AS outcome FROM e LEFT JOIN x USING (entry_id) LEFT JOIN z USING (entry_id)"""))
def title_resolution(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("y", 1900 + F.col("p_size") % 7)
    entries = p.select(F.col("p_partkey").alias("entry_id"), F.upper("p_name").alias("title"), F.col("y").alias("year"))
    films = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("film_id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("other").alias("title"), F.col("p_name").alias("original_title"), F.col("y").alias("year"))
    return identity.resolve_titles(entries, films)


@query("pending_promotion", oracle("""SELECT seq AS id, u.user_id, p.film_id, p.rating, CASE WHEN u.user_id IS NULL THEN 'failed' WHEN l.user_id IS NOT NULL OR row_number() OVER (PARTITION BY u.user_id, p.film_id ORDER BY seq) > 1 THEN 'retired' ELSE 'insert' END AS action
    FROM (SELECT r.user_id, r.film_id, r.seq, min(r.rating) AS rating FROM raw_logs r JOIN films f ON r.film_id = f.film_id WHERE f.year >= 1930 GROUP BY ALL) p LEFT JOIN (SELECT c_custkey AS user_id FROM customer WHERE c_acctbal >= 0) u ON u.user_id = p.user_id LEFT JOIN (SELECT user_id, film_id FROM logs WHERE rating IS NULL) l ON l.user_id = u.user_id AND l.film_id = p.film_id"""))
def pending_promotion(spark, sf_dir):
    """Every raw rating waits; films from 1930 on have been processed, customers without debts are known, unrated films are logged already."""
    raw = derived(spark, sf_dir, "raw_logs").groupBy("user_id", "film_id", "seq").agg(F.min("rating").alias("rating"))
    pending = raw.select(F.col("seq").alias("id"), F.col("user_id").cast("string").alias("username"), F.col("film_id").cast("string").alias("slug"), "rating")
    users = read(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").cast("string").alias("username"), F.col("c_custkey").alias("user_id"))
    processed = derived(spark, sf_dir, "films").where("year >= 1930").select(F.col("film_id").cast("string").alias("slug"), "film_id")
    return identity.promote_pending(pending, users, derived(spark, sf_dir, "logs").where("rating IS NULL"), processed)


@query("profile_reconciliation", oracle("""SELECT CAST(a.user_id AS VARCHAR) AS username, a.user_id, CAST(a.film_id AS VARCHAR) AS slug, p_partkey AS film_id, a.rating,
    CASE WHEN p_partkey IS NOT NULL AND l.user_id IS NULL THEN 'insert' WHEN p_partkey IS NOT NULL AND l.rating IS DISTINCT FROM a.rating THEN 'update' WHEN p_partkey IS NOT NULL THEN 'keep'
        WHEN q.film_id IS NULL THEN 'enqueue' WHEN q.runtime % 2 = 1 THEN 'terminal' WHEN a.user_id % 7 = 0 AND a.rating IS DISTINCT FROM 3.0 THEN 'refresh' ELSE 'wait' END AS action
    FROM (SELECT * FROM raw_logs QUALIFY row_number() OVER (PARTITION BY user_id, film_id ORDER BY seq DESC, source DESC, price DESC) = 1) a
    LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 5 <> 0) ON p_partkey = a.film_id LEFT JOIN (SELECT film_id, runtime FROM films WHERE year < 1960) q ON q.film_id = a.film_id LEFT JOIN logs l ON l.user_id = a.user_id AND l.film_id = a.film_id AND l.user_id % 2 = 0"""))
def profile_reconciliation(spark, sf_dir):
    raw = derived(spark, sf_dir, "raw_logs")
    profile = raw.select(F.col("user_id").cast("string").alias("username"), "user_id", F.col("film_id").cast("string").alias("slug"), "rating", F.struct("seq", "source", "price").alias("seq"))
    films = derived(spark, sf_dir, "films").where("film_id % 5 <> 0").select(F.col("film_id").cast("string").alias("slug"), "film_id")
    queue = derived(spark, sf_dir, "films").where("year < 1960").select(F.col("film_id").cast("string").alias("slug"), F.when(F.col("runtime") % 2 == 0, "PENDING").otherwise("FILTERED").alias("status"))
    pending = profile.where("user_id % 7 = 0").select("username", "slug", F.lit(3.0).alias("rating")).distinct()
    # Even users' orders alone make their logs; the condition on user_id wouldn't get below the window.
    logs = derived(spark, sf_dir, "logs", orders=read(spark, sf_dir, "orders").where("o_custkey % 2 = 0"))
    return identity.reconcile(profile, films, logs, queue, pending)


@query("terminal_propagation", oracle("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'FAILED' WHEN o_orderstatus = 'P' THEN 'PENDING' ELSE 'PROCESSED' END AS status FROM orders"))
def terminal_propagation(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    pending = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("slug"), F.when(F.col("o_orderstatus") == "P", "PENDING").otherwise("PROCESSED").alias("status"))
    queue = o.select(F.col("o_orderkey").cast("string").alias("slug"), F.when(F.col("o_orderkey") % 3 == 0, "FAILED").otherwise("PENDING").alias("status"))
    return identity.propagate_terminal(pending, queue).select("id", "status")


@query("catalog_refresh", oracle("SELECT film_id, year, CASE WHEN year IN (1940, 1941) THEN coalesce(CASE WHEN film_id % 2 = 0 THEN 4.5::DOUBLE END, 1.0::DOUBLE) ELSE 1.0::DOUBLE END AS avg_rating, CASE WHEN year IN (1940, 1941) AND film_id % 4 = 0 THEN 99 ELSE 7 END AS total_logs FROM films"))
def catalog_refresh(spark, sf_dir):
    films = derived(spark, sf_dir, "films").select("film_id", "year", F.lit(1.0).alias("avg_rating"), F.lit(7).alias("total_logs"))
    results = films.where("film_id % 2 = 0").select("film_id", F.lit(4.5).alias("avg_rating"), F.when(F.col("film_id") % 4 == 0, 99).alias("total_logs"))
    return identity.refreshed(films, results, F.array(F.lit(1940), F.lit(1941)).cast("array<bigint>"))


@query("donor_join", oracle("WITH u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM logs)) SELECT a.user_id, b.user_id AS donor_id FROM u a JOIN u b ON b.i = (a.i - 1 + 17) % a.n + 1"))
def donor_join(spark, sf_dir):
    return identity.donors(derived(spark, sf_dir, "logs"), 17)


@query("interaction_upsert", oracle("WITH t AS (SELECT *, NULL AS seq FROM logs UNION ALL SELECT user_id, film_id, 5.5 - rating, 1 FROM logs WHERE user_id % 3 = 0) SELECT user_id, film_id, rating FROM (SELECT *, row_number() OVER (PARTITION BY user_id, film_id ORDER BY seq DESC NULLS LAST) AS rn FROM t) WHERE rn = 1"))
def interaction_upsert(spark, sf_dir):
    logs = derived(spark, sf_dir, "logs")
    changes = logs.where("user_id % 3 = 0").select("user_id", "film_id", (5.5 - F.col("rating")).alias("rating"), F.lit(1).alias("seq"))
    return identity.upserted(logs, changes, ["user_id", "film_id"], "seq")


@query("snapshot_diff", oracle("SELECT user_id FROM logs WHERE user_id % 11 = 0 GROUP BY user_id HAVING count(*) FILTER (rating IS NOT NULL) > 0"))
def snapshot_diff(spark, sf_dir):
    logs = derived(spark, sf_dir, "logs")
    other = logs.withColumn("rating", F.when(F.col("user_id") % 11 == 0, F.col("rating") + 1).otherwise(F.col("rating")))
    a, b = (quality.fingerprint(x, "user_id", ["film_id", "rating"]) for x in (logs, other))
    return quality.fingerprint_diff(a, b, "user_id").select("user_id")


@query("rolling_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def rolling_counts(spark, sf_dir):
    return jobs.windowed(read(spark, sf_dir, "events"), "1 day").select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("sliding_counts", "SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) - to_days(CAST(k AS INT)) AS s FROM events, range(7) r(k)) GROUP BY 1, 2")
def sliding_counts(spark, sf_dir):
    return jobs.windowed(read(spark, sf_dir, "events"), "7 days", "1 day").select("start", "event_type", "n")


@query("sessions", "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, s")
def sessions(spark, sf_dir):
    return jobs.sessions(read(spark, sf_dir, "events"), "6 hours").select("user_id", "start", "n")


@query("latest_state", "SELECT user_id, max_by(event_type, event_id) AS state, count(*) AS n FROM events GROUP BY user_id")
def latest_state(spark, sf_dir):
    return jobs.latest_state(read(spark, sf_dir, "events"))


@query("stream_latest_state", "SELECT user_id, max_by(event_type, event_id) AS state, count(*) AS n FROM events GROUP BY user_id")
def stream_latest_state(spark, sf_dir):
    return jobs.drained(spark, f"{sf_dir}/events.parquet", jobs.latest_state, "complete")


@query("stream_rolling_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_rolling_counts(spark, sf_dir):
    return jobs.drained(spark, f"{sf_dir}/events.parquet", lambda d: jobs.windowed(d, "1 day").select("start", "event_type", "n"), "complete")


@query("stream_upsert", "SELECT user_id, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def stream_upsert(spark, sf_dir):
    return jobs.upsert_stream(spark, f"{sf_dir}/events.parquet", ["user_id"], "value", "event_id")


@query("stream_fresh")
def stream_fresh(spark, sf_dir):
    return jobs.drained(spark, f"{sf_dir}/events.parquet", lambda d: jobs.fresh(d, ["user_id"], "15 minutes").select("event_id", "user_id", "ts"), "append")
