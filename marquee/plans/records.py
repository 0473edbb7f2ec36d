"""Queries of record cleaning, catalog lookups, allocation reports, task streams and stored snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions import cleaning as C
from marquee.operators import evaluation as E
from marquee.operators import identity, ranking, shelves, vectors
from marquee.plans.core import NAMED, ORACLE, SHELF_SQL, candidate_union, parts, proposed, sql
from marquee.plans.evaluation import _SWEEP, _labels, _sweep, candidates_of_context, held_out_ranks, split, strata
from marquee.plans.registry import query
from marquee.sources import files
from marquee.sources.bridge import derived, kept, oracle, read
from marquee.sources.work import folder, saved
from marquee.streaming import jobs


@query("names_by_type", oracle("SELECT film_id, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (family = 'country'), '') AS countries, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (family = 'genre'), '') AS genres, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM film_entity GROUP BY film_id"))
def names_by_type(spark, sf_dir):
    padded = F.struct(F.col("family").alias("type"), F.concat(F.lit(" "), "name", F.lit("  ")).alias("name"))
    items = derived(spark, sf_dir, "film_entity").groupBy("film_id").agg(F.concat(F.collect_list(padded), F.array(F.struct(F.lit("country").alias("type"), F.lit("  ").alias("name")))).alias("items"))
    names = F.transform("items", lambda x: x["name"])
    joined = {"countries": C.names_of_type(F.col("items"), "country"), "genres": C.names_of_type(F.col("items"), "genre"), "names": C.names_set(names)}
    return items.select("film_id", *(F.array_join(F.array_sort(c), ",").alias(n) for n, c in joined.items()))


@query("clean_counts", "SELECT p_partkey, replace(p_name, ' ', ',') AS text, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS BIGINT) END AS count FROM part")
def clean_counts(spark, sf_dir):
    raw = F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("double")).when(F.col("p_size") % 3 == 1, F.col("p_size") + 0.5).otherwise(-F.col("p_size").cast("double"))
    return read(spark, sf_dir, "part").select("p_partkey", C.sanitised(F.replace("p_name", F.lit(" "), F.lit(";"))).alias("text"), C.valid_count(raw).alias("count"))


@query("refresh_due", "SELECT o_orderkey, CASE WHEN month(o_orderdate) = 7 THEN CAST(year(o_orderdate) - 1 AS VARCHAR) || ',' || CAST(year(o_orderdate) AS VARCHAR) ELSE CAST(year(o_orderdate) - 1 AS VARCHAR) END AS years FROM orders WHERE month(o_orderdate) IN (1, 7)")
def refresh_due(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").where(F.month("o_orderdate").isin(1, 7))
    return rows.select("o_orderkey", F.array_join(C.refresh_years(F.col("o_orderdate")), ",").alias("years"))


@query("valid_watches", "SELECT l_orderkey, l_linenumber, 'film-' || CAST(l_partkey AS VARCHAR) AS slug, CASE WHEN l_linenumber % 3 <> 2 AND l_quantity % 7 + CASE WHEN l_linenumber % 3 = 0 THEN 0.5 ELSE 0 END BETWEEN 0.5 AND 5 THEN CAST(l_quantity % 7 AS DOUBLE) + CASE WHEN l_linenumber % 3 = 0 THEN 0.5 ELSE 0 END END AS rating FROM lineitem WHERE l_partkey % 20 <> 0 AND l_partkey % 21 <> 0")
def valid_watches(spark, sf_dir):
    part, line = F.col("l_partkey"), F.col("l_linenumber") % 3
    slug = F.when(part % 20 == 0, "  ").when(part % 21 != 0, F.concat(F.lit(" film-"), part.cast("string"), F.lit(" ")))
    rating = F.concat((F.col("l_quantity") % 7).cast("int").cast("string"), F.when(line == 0, ".5").when(line == 1, " ").otherwise(".25"))
    return identity.valid_watches(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", slug.alias("slug"), rating.alias("rating")))


@query("scrape_results", "SELECT outcome, error, count(*) AS n, CAST(sum(attempts) AS BIGINT) AS attempts FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'FAILED' WHEN p_size < 10 THEN 'FILTERED' ELSE 'SUCCESS' END AS outcome, CASE WHEN p_partkey % 3 = 0 THEN 'Scraper returned no result' END AS error, p_size % 4 + 1 AS attempts FROM part) GROUP BY outcome, error")
def scrape_results(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("slug", F.col("p_partkey").cast("string"))
    results = p.where("p_partkey % 3 <> 0").select("slug", C.admission(F.col("p_name"), F.col("p_partkey"), F.col("p_size"), 10).alias("outcome"), F.lit(None).cast("string").alias("error"))
    out = identity.apply_results(p.select("slug", (F.col("p_size") % 4).alias("attempts")), results)
    return out.groupBy("outcome", "error").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


@query("cohort_logs", oracle("SELECT user_id, film_id, rating FROM logs WHERE film_id IN (SELECT film_id FROM item_vectors)"))
def cohort_logs(spark, sf_dir):
    return identity.in_catalog(derived(spark, sf_dir, "logs"), derived(spark, sf_dir, "item_vectors")).select("user_id", "film_id", "rating")


@query("watched_with_ratings", oracle("SELECT user_id, film_id, rating FROM logs"))
def watched_with_ratings(spark, sf_dir):
    logs = kept(spark, sf_dir, "logs")  # read twice
    rated = logs.where("rating IS NOT NULL")
    never = rated.select("user_id", (-1 - F.col("film_id")).alias("film_id"), "rating")  # rated, but not watched
    return identity.watched_with_ratings(logs.select("user_id", "film_id"), rated.unionByName(never))


@query("films_of_years", oracle("SELECT film_id, CASE WHEN film_id % 9 <> 0 THEN year END AS year FROM films WHERE film_id % 9 = 0 OR year IN (SELECT 1900 + 2 * min(p_size) FROM part UNION ALL SELECT 1900 + 2 * max(p_size) FROM part)"))
def films_of_years(spark, sf_dir):
    films = derived(spark, sf_dir, "films").select("film_id", F.when(F.col("film_id") % 9 != 0, F.col("year")).alias("year"))
    ends = derived(spark, sf_dir, "films").agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    return identity.of_years(films, ends.select(F.explode(F.array("lo", "hi")).alias("year")))


@query("film_relations", oracle("SELECT DISTINCT film_id, entity_id FROM film_country"))
def film_relations(spark, sf_dir):
    films = derived(spark, sf_dir, "film_country").groupBy("film_id").agg(F.collect_list("name").alias("countries"))
    films = films.withColumn("countries", F.concat("countries", "countries"))
    return identity.exploded_relation(films, "countries", read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("bigint").alias("id")))


@query("first_seen", oracle("SELECT user_id, film_id, min_by(source, seq * 1000000 + source) AS source, count(DISTINCT source) > 1 AS conflict FROM raw_logs GROUP BY user_id, film_id"))
def first_seen(spark, sf_dir):
    return identity.first_seen(derived(spark, sf_dir, "raw_logs").withColumn("o", F.col("seq") * 1000000 + F.col("source")), ["user_id", "film_id"], ["source"], "o")


@query("ranker_catalog", oracle("SELECT f.film_id, f.year, f.runtime, family, string_agg(CAST(entity_id AS VARCHAR), ',' ORDER BY entity_id) AS ids FROM films f JOIN (SELECT DISTINCT film_id, family, entity_id FROM film_entity) e ON e.film_id = f.film_id WHERE f.film_id IN (SELECT film_id FROM logs) GROUP BY f.film_id, f.year, f.runtime, family"))
def ranker_catalog(spark, sf_dir):
    films = identity.in_catalog(derived(spark, sf_dir, "films"), derived(spark, sf_dir, "logs")).select("film_id", "year", "runtime")
    families = derived(spark, sf_dir, "film_entity").groupBy("film_id", "family").agg(F.array_join(F.array_sort(F.collect_set("entity_id")), ",").alias("ids"))
    return films.join(families, "film_id")


@query("unavailable_shelves", sql("SELECT user_id, count(*) AS missing FROM (SELECT u.user_id, k.key FROM (SELECT DISTINCT user_id FROM logs) u CROSS JOIN (SELECT DISTINCT key FROM shelved) k WHERE (u.user_id, k.key) NOT IN (SELECT (user_id, key) FROM shelved)) GROUP BY user_id"))
def unavailable_shelves(spark, sf_dir):
    have = saved(proposed(parts(spark, sf_dir), {NAMED.get(k, k) for k in SHELF_SQL}).groupBy("user_id").agg(F.collect_set("key").alias("keys")))
    rows = have.select("user_id", F.explode("keys").alias("key"))
    keys = rows.select("key").distinct()
    missing = shelves.unavailable(rows, kept(spark, sf_dir, "logs").select("user_id").distinct()).select("user_id", F.explode("keys").alias("key"))
    return missing.join(F.broadcast(keys), "key", "left_semi").groupBy("user_id").agg(F.count("*").alias("missing"))  # ten keys at most


ORACLE["labelled"] = "SELECT user_id, film_id, rating, year, CASE WHEN rating >= 4.5 THEN 3 WHEN rating >= 4 THEN 2 WHEN rating >= 3.5 THEN 1 WHEN rating IS NOT NULL THEN 0 END AS label FROM logs LEFT JOIN (SELECT * FROM films WHERE film_id % 4 <> 0) USING (film_id)"


@query("dataset_audit", sql("SELECT name, value FROM (SELECT 'rows_' AS name, count(*)::DOUBLE AS value FROM labelled UNION ALL SELECT 'groups', count(DISTINCT user_id)::DOUBLE FROM labelled UNION ALL SELECT 'label_' || k, (SELECT round(avg(CASE WHEN label IS NOT NULL THEN (label = k)::INT::DOUBLE END), 6) FROM labelled) FROM range(4) r(k) UNION ALL SELECT 'missing_rating', round(avg((rating IS NULL)::INT::DOUBLE), 6) FROM labelled UNION ALL SELECT 'missing_year', round(avg((year IS NULL)::INT::DOUBLE), 6) FROM labelled)"))
def dataset_audit(spark, sf_dir):
    r = F.col("rating")
    label = F.when(r >= 4.5, 3).when(r >= 4, 2).when(r >= 3.5, 1).when(r.isNotNull(), 0)
    rows = derived(spark, sf_dir, "logs").join(derived(spark, sf_dir, "films").where("film_id % 4 <> 0"), "film_id", "left").withColumn("label", label)
    return E.dataset_audit(rows, ["rating", "year"])


@query("full_groups", sql("WITH c AS (SELECT user_id, film_id FROM cand WHERE (user_id, film_id) NOT IN (SELECT (user_id, film_id) FROM split WHERE role = 'context')) SELECT user_id, film_id, coalesce(label, 0) AS label FROM c LEFT JOIN (SELECT user_id, film_id, 2 AS label FROM split WHERE role <> 'context') USING (user_id, film_id)"))
def full_groups(spark, sf_dir):
    return E.full_groups(candidate_union(spark, sf_dir).select("user_id", "film_id"), split(spark, sf_dir).where("role = 'context'"), _labels(spark, sf_dir)).select("user_id", "film_id", "label")


_WEIGHTED = "WITH s AS (SELECT user_id, sum(rating - 3) AS w, sum((rating - 3) * x) AS wx, sum((rating - 3) * x * x) AS wxx FROM logs JOIN ({}) USING (film_id) WHERE rating > 3 GROUP BY user_id) SELECT user_id, round(wx / w, 4) AS mean, round(sqrt(greatest(wxx / w - (wx / w) * (wx / w), 0)), 4) AS deviation FROM s"


@query("weighted_runtime", sql(_WEIGHTED.format("SELECT film_id, runtime::DOUBLE AS x FROM films")))
def weighted_runtime(spark, sf_dir):
    return E.weighted_preferences(derived(spark, sf_dir, "logs"), derived(spark, sf_dir, "films"), "runtime")


@query("weighted_popularity", sql(_WEIGHTED.format("SELECT film_id, popularity_rank::DOUBLE AS x FROM pop")))
def weighted_popularity(spark, sf_dir):
    logs = derived(spark, sf_dir, "logs")
    return E.weighted_preferences(logs, ranking.popularity(logs), "popularity_rank")


_BUDGETS, _RATIOS = [40, 80, 120, 160, 200, 240, 280, 320, 400], [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]


@query("allocation_report", sql(f"""WITH grid AS (SELECT budget, ratio, CAST(round_even(budget * ratio, 0) AS INT) AS sd, budget - CAST(round_even(budget * ratio, 0) AS INT) AS pd FROM (VALUES {', '.join(f'({b})' for b in _BUDGETS)}) b(budget), (VALUES {', '.join(f'({r}::DOUBLE)' for r in _RATIOS)}) r(ratio)),
    hits AS (SELECT budget, ratio, stratum, CASE WHEN coalesce(svd_rank <= sd, false) OR coalesce(popularity_rank <= pd, false) THEN 1.0::DOUBLE ELSE 0 END AS h FROM held, grid),
    got AS (SELECT budget, ratio, user_id, film_id FROM c_cand, grid WHERE coalesce(svd_rank <= sd, false) OR coalesce(popularity_rank <= pd, false)),
    pct AS (SELECT film_id, 1 - percent_rank() OVER (ORDER BY popularity_rank) AS p FROM pop),
    r AS (SELECT budget, ratio, round(avg(h), 6) AS recall, round(avg(h) FILTER (stratum = 'HEAD'), 6) AS recall_head, round(avg(h) FILTER (stratum = 'MID'), 6) AS recall_mid, round(avg(h) FILTER (stratum = 'TAIL'), 6) AS recall_tail FROM hits GROUP BY budget, ratio),
    s AS (SELECT budget, ratio, round(count(*) / (SELECT count(DISTINCT user_id) FROM c_cand), 6) AS mean_size, round(avg(p), 6) AS mean_percentile, count(DISTINCT film_id) AS films FROM got JOIN pct USING (film_id) GROUP BY budget, ratio)
    SELECT budget, ratio, recall, recall_head, recall_mid, recall_tail, mean_size, mean_percentile, films FROM r JOIN s USING (budget, ratio)"""))
def allocation_report(spark, sf_dir):
    candidates = saved(candidates_of_context(spark, sf_dir).select("user_id", "film_id", "svd_rank", "popularity_rank"))
    films = saved(strata(spark, sf_dir).join(candidates.select("film_id").distinct(), "film_id", "left_semi"))
    return E.allocation_report(held_out_ranks(spark, sf_dir), candidates, ranking.small(films), _BUDGETS, _RATIOS)


@query("recommended_sources", sql(f"WITH {_SWEEP}, m AS (SELECT budget, round(recall - lag(recall) OVER (ORDER BY budget), 6) AS gain FROM (SELECT budget, max(recall) AS recall FROM sweep GROUP BY budget)), c AS (SELECT coalesce(min(budget) FILTER (budget >= 100 AND gain < 0.02), max(budget) FILTER (budget <= 400)) AS budget FROM m) SELECT budget, ratio, CAST(round(budget * ratio) AS BIGINT) AS svd_depth, budget - CAST(round(budget * ratio) AS BIGINT) AS popularity_depth, recall FROM sweep WHERE budget = (SELECT budget FROM c) ORDER BY recall DESC, ratio LIMIT 1"))
def recommended_sources(spark, sf_dir):
    sweep = saved(_sweep(spark, sf_dir))
    return E.recommended_sources(sweep, E.chosen_budget(E.marginal_value(sweep), least=100, most=400))


_ENDED = ["purchase", "error"]
_STATES = "SELECT user_id, coalesce(min_by(event_type, event_id) FILTER (event_type IN ('purchase', 'error')), max_by(event_type, event_id)) AS state, count(*) FILTER (event_type IN ('purchase', 'error')) > 0 AS terminal, count(*) AS n FROM events GROUP BY user_id"


@query("task_states", _STATES)
def task_states(spark, sf_dir):
    return jobs.task_states(read(spark, sf_dir, "events"), _ENDED)


@query("stream_task_states", _STATES)
def stream_task_states(spark, sf_dir):
    return jobs.drained(spark, f"{sf_dir}/events.parquet", lambda d: jobs.task_states(d, _ENDED), "complete")


@query("stream_sync_requests")
def stream_sync_requests(spark, sf_dir):
    kind = F.col("event_type")
    return jobs.drained(spark, f"{sf_dir}/events.parquet", lambda d: jobs.sync_requests(d.withColumns({"forced": kind == "signup", "failed": kind == "error"}), 86_400), "append")


@query("pending_arrivals", "SELECT p.event_id, p.user_id AS slug, a.event_id AS film_id FROM (SELECT * FROM events WHERE event_type = 'view') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') a ON a.user_id = p.user_id AND a.ts BETWEEN p.ts AND p.ts + INTERVAL 2 DAY")
def pending_arrivals(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    pending = events.where("event_type = 'view'").select("event_id", F.col("user_id").alias("slug"), "ts")
    arrivals = events.where("event_type = 'purchase'").select(F.col("user_id").alias("slug"), F.col("ts").alias("arrived_at"), F.col("event_id").alias("film_id"))
    return jobs.pending_matches(pending, arrivals, "2 days").select("event_id", "slug", "film_id")


@query("rolling_top", "SELECT start, user_id, n, place FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY n DESC, user_id) AS place FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) - to_days(CAST(k AS INT)) AS start, user_id, count(*) AS n FROM events, range(7) r(k) WHERE value >= 50 GROUP BY 1, 2)) WHERE place <= 5")
def rolling_top(spark, sf_dir):
    return jobs.rolling_top(read(spark, sf_dir, "events"), "user_id", F.col("value") >= 50, "7 days", "1 day", 5)


@query("stored_vectors", oracle("SELECT film_id, round(list_aggregate(vec::DOUBLE[], 'sum'), 4) AS total FROM item_vectors"))
def stored_vectors(spark, sf_dir):
    path = folder(spark)
    files.write_vectors(derived(spark, sf_dir, "item_vectors"), path)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return files.read_vectors(spark, path).select("film_id", F.round(total, 4).alias("total"))


@query("appended_logs", oracle("SELECT user_id, film_id, rating FROM logs"))
def appended_logs(spark, sf_dir):
    path, logs = folder(spark), saved(derived(spark, sf_dir, "logs"))
    for part in ("user_id % 2 = 0", "user_id % 2 <> 0"):
        files.append_interactions(logs.where(part), path)
    return spark.read.parquet(path)


@query("snapshot", oracle("SELECT 'item_vectors' AS part, count(DISTINCT film_id) AS rows_ FROM logs WHERE rating IS NOT NULL UNION ALL SELECT 'popularity', count(DISTINCT film_id) FROM logs WHERE rating IS NOT NULL"))
def snapshot(spark, sf_dir):
    """A snapshot of the rated logs: item vectors and popularity, written, read back through their gates, over the same films."""
    path, rated = folder(spark), saved(derived(spark, sf_dir, "logs").where("rating IS NOT NULL"))
    files.write_vectors(vectors.truncated_svd(rated, 16), f"{path}/item_vectors")
    files.write_popularity(ranking.popularity(rated), f"{path}/popularity")
    items, popular = files.read_vectors(spark, f"{path}/item_vectors"), files.read_popularity(spark, f"{path}/popularity")
    files.gate(items.select("film_id").exceptAll(popular.select("film_id")), "a film has a vector and no popularity")
    counts = (d.agg(F.lit(n).alias("part"), F.count("*").alias("rows_")) for n, d in (("item_vectors", items), ("popularity", popular)))
    return next(counts).unionByName(next(counts))
