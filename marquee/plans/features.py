"""Queries of ranking features, the fusion's calibration and shelf reports, on the library's own candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators import evaluation as E
from marquee.operators import features as X
from marquee.operators import preferences, ranking, vectors
from marquee.plans.core import DEPTH, NAMED, ORACLE, SHELF_SQL, Parts, candidate_union, inventory, parts, proposed, sources, sql
from marquee.plans.evaluation import _M, context, held_out_ranks, popularity_of_context, split, strata
from marquee.plans.registry import query
from marquee.sources.bridge import derived, kept

FAMILIES = ["director", "genre", "country", "language", "decade"]


@query("source_features", sql(f"""SELECT user_id, film_id, CAST(least(coalesce(svd_rank, 1000000000), coalesce(popularity_rank, 1000000000)) AS BIGINT) AS least_rank, {", ".join(f"round(1.0::DOUBLE / {c}_rank, 6) AS {c}_reciprocal, round({c}_rank / {DEPTH}.0::DOUBLE, 6) AS {c}_fraction, round(ln(1 + {c}_rank::DOUBLE), 6) AS {c}_log" for c in ("svd", "popularity"))}, abs(svd_rank - popularity_rank) AS rank_gap FROM cand"""))
def source_features(spark, sf_dir):
    return X.source_features(candidate_union(spark, sf_dir), DEPTH)


@query("catalog_features", sql(f"""WITH n AS (SELECT film_id, {", ".join(f"count(*) FILTER (family = '{f}') AS n_{f}" for f in FAMILIES)} FROM film_entity GROUP BY film_id) SELECT film_id, year, CAST(floor(year / 10.0) * 10 AS BIGINT) AS decade, 2026 - year AS age, runtime, round(ln(1 + runtime::DOUBLE), 6) AS log_runtime,
    CAST(year IS NULL AS INT) AS year_missing, CAST(runtime IS NULL AS INT) AS runtime_missing, {", ".join(f"coalesce(n_{f}, 0) AS n_{f}" for f in FAMILIES)} FROM films LEFT JOIN n USING (film_id)"""))
def catalog_features(spark, sf_dir):
    return X.catalog_features(derived(spark, sf_dir, "films"), derived(spark, sf_dir, "film_entity"), FAMILIES)


@query("stratum_fractions", sql("SELECT user_id, " + ", ".join(f"round(avg(CASE WHEN stratum = '{s}' THEN 1.0::DOUBLE ELSE 0 END), 6) AS {s.lower()}" for s in ("HEAD", "MID", "TAIL")) + " FROM logs JOIN strata USING (film_id) WHERE rating >= 3.5 GROUP BY user_id"))
def stratum_fractions(spark, sf_dir):
    return X.stratum_fractions(derived(spark, sf_dir, "logs").where("rating >= 3.5"), strata(spark, sf_dir))


def _weighted(name: str) -> str:
    return f"w{name} AS (SELECT user_id, round(wx / w, 4) AS m, round(sqrt(greatest(wxx / w - (wx / w) * (wx / w), 0)), 4) AS s FROM (SELECT user_id, sum(rating - 3) AS w, sum((rating - 3) * {name}::DOUBLE) AS wx, sum((rating - 3) * {name}::DOUBLE * {name}) AS wxx FROM logs JOIN films USING (film_id) WHERE rating > 3 GROUP BY user_id))"


@query("distance_features", sql(f"WITH {_weighted('year')}, {_weighted('runtime')} SELECT user_id, film_id, " + ", ".join(f"round(abs({n} - w{n}.m), 4) AS {n}_distance, round(abs({n} - w{n}.m) / greatest(w{n}.s, 1.0::DOUBLE), 4) AS {n}_z" for n in ("year", "runtime")) + " FROM popcand LEFT JOIN films USING (film_id) LEFT JOIN wyear USING (user_id) LEFT JOIN wruntime USING (user_id)"))
def distance_features(spark, sf_dir):
    logs, films = kept(spark, sf_dir, "logs"), derived(spark, sf_dir, "films")
    places = ranking.watched_places(logs, ranking.popularity(logs), DEPTH)
    return X.popular_distances(places, DEPTH, films.select("film_id", "year", "runtime"), E.each_weighted(logs, films, ["year", "runtime"]))


@query("feature_matrix")
def feature_matrix(spark, sf_dir):
    """Every candidate with its source, catalog, film, user and distance features and an affinity block a family."""
    logs, films, entity = kept(spark, sf_dir, "logs"), *(derived(spark, sf_dir, n) for n in ("films", "film_entity"))
    rows = candidate_union(spark, sf_dir).select("user_id", "film_id", "svd_rank", "popularity_rank")
    affinity = E.candidate_affinity(rows, entity, E.ranker_affinity(logs, entity)).groupBy("user_id", "film_id").pivot("family", FAMILIES).agg(*(F.first(c).alias(c) for c in ("mean", "best", "worst", "support", "matched", "matched_fraction")))

    def named(frame: DataFrame, mark: str) -> DataFrame:
        return frame.select(*(F.col(c) if c in ("user_id", "film_id") else F.col(c).alias(f"{mark}_{c}") for c in frame.columns))

    distance = X.distance_features(rows, films.select("film_id", "year", "runtime"), {c: E.weighted_preferences(logs, films, c) for c in ("year", "runtime")})
    shares = X.stratum_fractions(logs.where("rating >= 3.5"), strata(spark, sf_dir))
    tables = [X.source_features(rows, DEPTH), named(X.catalog_features(films, entity, FAMILIES), "catalog"), named(E.film_aggregates(logs), "film"), named(E.user_features(logs), "user"), named(shares, "share"), distance, affinity]
    return X.feature_matrix(tables, ["user_id", "film_id"])


_GRID = f"""grid AS (SELECT w::DOUBLE AS w, k FROM (VALUES {", ".join(f"({w})" for w in X.WEIGHTS)}) a(w), (VALUES {", ".join(f"({k})" for k in X.KS)}) b(k)),
    gs AS (SELECT user_id, film_id, w, k, round(coalesce(w / (k + svd_rank), 0) + coalesce((1 - w) / (k + popularity_rank), 0), 12) AS score FROM c_cand, grid),
    gr AS (SELECT * FROM (SELECT w, k, user_id, film_id, row_number() OVER (PARTITION BY w, k, user_id ORDER BY score DESC, film_id) AS rank FROM gs)),
    gt AS (SELECT g.w AS svd_weight, g.k, t.user_id, t.film_id, gr.rank FROM (SELECT user_id, film_id FROM split WHERE role = 'test') t CROSS JOIN grid g LEFT JOIN gr ON gr.user_id = t.user_id AND gr.film_id = t.film_id AND gr.w = g.w AND gr.k = g.k),
    gm AS (SELECT svd_weight, k, {_M} FROM gt GROUP BY svd_weight, k)"""


def _grid(spark, sf_dir) -> DataFrame:
    targets = split(spark, sf_dir).where("role = 'test'").select("user_id", "film_id")
    lists, places = sources(context(spark, sf_dir), derived(spark, sf_dir, "item_vectors"), popularity_of_context(spark, sf_dir), DEPTH, targets)
    found = X.grid_of_lists(ranking.rank_lists(lists, places, DEPTH)).select("user_id", "film_id", "cells")
    # Targets of users without candidates count as misses.
    none = F.array(*(F.struct(F.lit(w).alias("svd_weight"), F.lit(k).alias("k"), F.lit(None).cast("bigint").alias("rank")) for w in X.WEIGHTS for k in X.KS))
    cells = targets.join(found, ["user_id", "film_id"], "left").select(F.explode(F.coalesce("cells", none)).alias("c")).select("c.*")
    return E.metrics(cells, ["svd_weight", "k"])


@query("rrf_calibration", sql(f"WITH {_GRID} SELECT * FROM gm"))
def rrf_calibration(spark, sf_dir):
    return _grid(spark, sf_dir)


_NEAR = "round(abs(svd_weight - 0.5), 6) * 1000 + abs(k - 60)"


@query("rrf_selected", sql(f"WITH {_GRID} SELECT svd_weight, k, ndcg_20, recall_20 FROM gm ORDER BY ndcg_20 DESC, recall_20 DESC, {_NEAR}, svd_weight, k LIMIT 1"))
def rrf_selected(spark, sf_dir):
    return _grid(spark, sf_dir).orderBy(F.desc("ndcg_20"), F.desc("recall_20"), X.nearness(F.col("svd_weight"), F.col("k")), "svd_weight", "k").limit(1).select("svd_weight", "k", "ndcg_20", "recall_20")


@query("rrf_plateau", sql(f"WITH {_GRID}, r AS (SELECT svd_weight, k, ndcg_20, round(max(ndcg_20) OVER () - ndcg_20, 6) AS regret FROM gm), n AS (SELECT *, regret <= 0.001 AS near FROM r) SELECT *, near AND row_number() OVER (PARTITION BY near ORDER BY {_NEAR}, svd_weight, k) = 1 AS chosen FROM n"))
def rrf_plateau(spark, sf_dir):
    return X.plateau(_grid(spark, sf_dir))


_STRATEGIES = "bl AS (" + " UNION ALL ".join(f"SELECT '{n}' AS strategy, {c} AS rank FROM (SELECT user_id, film_id FROM split WHERE role = 'test') t LEFT JOIN c_ranked r USING (user_id, film_id)" for n, c in (("fused", "rrf_rank"), ("vector", "svd_rank"), ("popularity", "popularity_rank"))) + f"), bm AS (SELECT strategy, {_M} FROM bl GROUP BY strategy)"


def _strategies(spark, sf_dir) -> DataFrame:
    rows = held_out_ranks(spark, sf_dir)
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("strategy"), F.col(c).cast("bigint").alias("rank")) for n, c in (("fused", "rank"), ("vector", "svd_rank"), ("popularity", "popularity_rank"))))).alias("s")).select("s.*")
    return E.metrics(long, ["strategy"])


@query("baseline_comparison", sql(f"WITH {_STRATEGIES} SELECT * FROM bm"))
def baseline_comparison(spark, sf_dir):
    return _strategies(spark, sf_dir)


@query("lift", sql(f"WITH {_STRATEGIES} SELECT a.strategy, round(a.ndcg_20 - b.ndcg_20, 6) AS absolute, round(CASE WHEN b.ndcg_20 <> 0 THEN (a.ndcg_20 - b.ndcg_20) / b.ndcg_20 END, 6) AS relative FROM bm a, (SELECT ndcg_20 FROM bm WHERE strategy = 'popularity') b"))
def lift(spark, sf_dir):
    return X.lift(_strategies(spark, sf_dir), "popularity")


@query("score_distribution", sql("SELECT segment, count(*) AS rows_, round(avg(rrf_score), 6) AS mean, round(stddev_pop(rrf_score), 6) AS deviation FROM (SELECT rrf_score, membership AS segment FROM ranked UNION ALL SELECT rrf_score, stratum FROM ranked) GROUP BY segment"))
def score_distribution(spark, sf_dir):
    return X.score_distribution(inventory(spark, sf_dir))


ORACLE["shelved"] = " UNION ALL ".join(f"SELECT '{k}' AS key, user_id, film_id, pos FROM ({text})" for k, text in SHELF_SQL.items())


def _shelves(spark, sf_dir) -> DataFrame:
    return listed(parts(spark, sf_dir))


def listed(p: Parts) -> DataFrame:
    """All shelves that SQL can say, under the queries' keys: key, user_id, film_id, pos, head. The rows of a user lie together."""
    rows = proposed(p, {NAMED.get(k, k) for k in SHELF_SQL})
    key = F.col("key")
    for query_key, own in NAMED.items():
        key = F.when(F.col("key") == own, query_key).otherwise(key)
    return rows.select(key.alias("key"), "user_id", "film_id", "pos", "head")


@query("shelf_report", sql("SELECT key, count(DISTINCT user_id) AS users, round(count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM logs)::DOUBLE, 6) AS activation, round(count(*) / count(DISTINCT user_id)::DOUBLE, 6) AS mean_size, count(DISTINCT film_id) AS films, round(avg(CASE WHEN stratum = 'HEAD' THEN 1.0::DOUBLE ELSE 0 END), 6) AS head_share FROM shelved JOIN strata USING (film_id) GROUP BY key"))
def shelf_report(spark, sf_dir):
    p = parts(spark, sf_dir)
    return X.shelf_report(listed(p), kept(spark, sf_dir, "logs"), p["strata"])


@query("shelf_overlap", sql("WITH t AS (SELECT * FROM shelved WHERE pos <= 20), n AS (SELECT user_id, key, count(*) AS n FROM t GROUP BY user_id, key), c AS (SELECT a.user_id, a.key AS ka, b.key AS kb, count(*) AS c FROM t a JOIN t b ON a.user_id = b.user_id AND a.film_id = b.film_id AND a.key < b.key GROUP BY ALL) SELECT a.key AS key_a, b.key AS key_b, count(*) AS users, round(avg(coalesce(c, 0) / (a.n + b.n - coalesce(c, 0))::DOUBLE), 6) AS jaccard FROM n a JOIN n b ON a.user_id = b.user_id AND a.key < b.key LEFT JOIN c ON c.user_id = a.user_id AND ka = a.key AND kb = b.key GROUP BY a.key, b.key"))
def shelf_overlap(spark, sf_dir):
    return X.shelf_overlap(_shelves(spark, sf_dir))


@query("portfolio_sizes", sql("WITH f AS (SELECT user_id, film_id, count(*) AS n FROM shelved GROUP BY user_id, film_id), k AS (SELECT user_id, count(DISTINCT key) AS categories FROM shelved GROUP BY user_id) SELECT user_id, categories, CAST(sum(n) AS BIGINT) AS slots, count(*) AS films, round(1 - count(*) / sum(n)::DOUBLE, 6) AS duplicate_rate, max(n) AS most FROM f JOIN k USING (user_id) GROUP BY user_id, categories"))
def portfolio_sizes(spark, sf_dir):
    return X.portfolio_sizes(_shelves(spark, sf_dir))


@query("director_threshold_audit", sql("SELECT setting, count(DISTINCT user_id) AS users, count(*) AS entities, round(avg(support), 6) AS mean_support FROM prefs, (VALUES ('loose', 2, 1, 0), ('default', 2, 2, 1), ('strict', 4, 3, 2)) g(setting, s, p, h) WHERE family = 'director' AND affinity > 0 AND support >= s AND positive >= p AND high >= h GROUP BY setting"))
def director_threshold_audit(spark, sf_dir):
    prefs = preferences.entity_preferences(derived(spark, sf_dir, "logs"), derived(spark, sf_dir, "film_entity"))
    return X.threshold_audit(prefs.where("family = 'director'"), [("loose", 2, 1, 0), ("default", 2, 2, 1), ("strict", 4, 3, 2)])


@query("target_scores", sql("SELECT t.user_id, t.film_id, round(list_inner_product(uvec, vec::DOUBLE[]), 6) AS score FROM (SELECT user_id, film_id FROM split WHERE role = 'test') t LEFT JOIN c_uservec USING (user_id) LEFT JOIN item_vectors v ON v.film_id = t.film_id"))
def target_scores(spark, sf_dir):
    rows, items = split(spark, sf_dir), derived(spark, sf_dir, "item_vectors")
    return X.target_scores(vectors.user_profiles(rows.where("role = 'context'"), items), rows.where("role = 'test'"), items)


@query("mean_pool_recommendations", sql("""WITH d AS (SELECT user_id, d, avg(x) AS x FROM (SELECT user_id, unnest(vec)::DOUBLE AS x, generate_subscripts(vec, 1) AS d FROM logs JOIN item_vectors USING (film_id) WHERE rating IS NOT NULL) GROUP BY user_id, d), m AS (SELECT user_id, list(x ORDER BY d) AS u FROM d GROUP BY user_id),
    s AS (SELECT user_id, i.film_id, round(list_inner_product(u, vec::DOUBLE[]), 6) AS score FROM m, item_vectors i WHERE (user_id, i.film_id) NOT IN (SELECT (user_id, film_id) FROM logs)), j AS (SELECT user_id, film_id, title, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, film_id) AS place FROM s JOIN films USING (film_id)) SELECT * FROM j WHERE place <= 10"""))
def mean_pool_recommendations(spark, sf_dir):
    logs, items, films = kept(spark, sf_dir, "logs"), *(derived(spark, sf_dir, n) for n in ("item_vectors", "films"))
    found = vectors.exact_top_k(vectors.user_profiles(logs, items, "mean"), items.join(films.select("film_id"), "film_id", "left_semi"), 10, logs)
    return found.join(films.select("film_id", "title"), "film_id").select("user_id", "film_id", "title", F.col("svd_score").alias("score"), F.col("svd_rank").alias("place"))


@query("catalog_cut", sql("SELECT film_id, logs, place FROM (SELECT film_id, count(*) AS logs, row_number() OVER (ORDER BY count(*) DESC, film_id) AS place FROM logs GROUP BY film_id) WHERE place <= 1500"))
def catalog_cut(spark, sf_dir):
    counts = derived(spark, sf_dir, "logs").groupBy("film_id").agg(F.count("*").alias("logs"))
    return ranking.rank_by_value(counts, "logs", "film_id", "place").where("place <= 1500").select("film_id", "logs", "place")


@query("training_statistics", sql("SELECT count(DISTINCT user_id) AS users, count(*) AS pairs, count(DISTINCT film_id) AS films FROM logs WHERE rating IS NOT NULL"))
def training_statistics(spark, sf_dir):
    return derived(spark, sf_dir, "logs").where("rating IS NOT NULL").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("pairs"), F.count_distinct("film_id").alias("films"))


@query("candidate_preview", sql("SELECT user_id, count(svd_rank) AS by_vector, count(popularity_rank) AS by_popularity, count(*) FILTER (membership = 'both') AS overlap, count(*) AS candidates FROM cand GROUP BY user_id"))
def candidate_preview(spark, sf_dir):
    return candidate_union(spark, sf_dir).groupBy("user_id").agg(F.count("svd_rank").alias("by_vector"), F.count("popularity_rank").alias("by_popularity"), F.count_if(F.col("membership") == "both").alias("overlap"), F.count("*").alias("candidates"))


@query("paired_reports", sql("SELECT count(*) AS paired, count(*) FILTER (a IS NULL OR b IS NULL) AS unpaired, round(avg(a - b), 6) AS mean_difference FROM (SELECT user_id, avg(rating) AS a FROM logs GROUP BY user_id) x FULL JOIN (SELECT user_id, avg(rating) AS b FROM split WHERE role = 'context' GROUP BY user_id) y USING (user_id)"))
def paired_reports(spark, sf_dir):
    a = derived(spark, sf_dir, "logs").groupBy("user_id").agg(F.avg("rating").alias("a"))
    b = split(spark, sf_dir).where("role = 'context'").groupBy("user_id").agg(F.avg("rating").alias("b"))
    return a.join(b, "user_id", "full").agg(F.count("*").alias("paired"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unpaired"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("mean_difference"))
