"""Queries of the offline evaluation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from marquee.operators import evaluation as E
from marquee.operators import quality, ranking
from marquee.plans.core import DEPTH, ORACLE, candidate_union, inventory, sources, sql
from marquee.plans.registry import ORACLES, query
from marquee.sources.bridge import derived, kept

_KEY = "md5(concat_ws(':', '42', CAST(user_id AS VARCHAR), CAST(film_id AS VARCHAR)))"
ORACLE |= {
    "split": f"""SELECT user_id, film_id, rating, CASE WHEN rating >= 3.5 AND e AND p = 1 THEN 'validation' WHEN rating >= 3.5 AND e AND p = 2 THEN 'test' ELSE 'context' END AS role FROM (SELECT *, row_number() OVER (PARTITION BY user_id, rating >= 3.5 ORDER BY {_KEY}) AS p,
        count(*) FILTER (rating >= 3.5) OVER (PARTITION BY user_id) >= 3 AS e FROM logs WHERE rating IS NOT NULL)""",
    "targetrank": "SELECT t.user_id, t.film_id, r.rrf_rank AS rank FROM (SELECT user_id, film_id FROM logs WHERE rating >= 4.5) t LEFT JOIN ranked r USING (user_id, film_id)",
    "ctx": "SELECT user_id, film_id, rating FROM split WHERE role = 'context'",
}
#: The tables up to the fused candidates, from the context alone.
_CONTEXT = ["pop", "strata", "userdim", "uservec", "svdall", "svd", "popcand", "cand", "rrf", "ranked"]
ORACLE |= {f"c_{n}": re.sub(rf"\b(logs|{'|'.join(_CONTEXT)})\b", lambda m: "ctx" if m[0] == "logs" else f"c_{m[0]}", ORACLE[n]) for n in _CONTEXT}
ORACLE["held"] = "SELECT t.user_id, t.film_id, s.stratum, r.rrf_rank AS rank, r.svd_rank, r.popularity_rank FROM (SELECT user_id, film_id FROM split WHERE role = 'test') t JOIN strata s USING (film_id) LEFT JOIN c_ranked r USING (user_id, film_id)"


def split(spark, sf_dir):
    """The split, written once a query."""
    return kept(spark, sf_dir, "split", _split)


def _split(spark, sf_dir, _name):
    logs = kept(spark, sf_dir, "logs")
    return E.holdout(logs, tasks=E.tasks_for(logs))


def strata(spark, sf_dir):
    return ranking.with_strata(ranking.popularity(kept(spark, sf_dir, "logs")))


def context(spark, sf_dir):
    return split(spark, sf_dir).where("role = 'context'").select("user_id", "film_id", "rating")


def popularity_of_context(spark, sf_dir):
    """Popularity among the context rows of the split, written once a query."""
    return kept(spark, sf_dir, "context_popularity", _popularity_of_context)


def _popularity_of_context(spark, sf_dir, _name):
    return ranking.popularity(context(spark, sf_dir))


def candidates_of_context(spark, sf_dir, given=None, wanted=None):
    """Every user's fused candidates of both sources, from the context rows of the split alone or from those given, a stored table; only those wanted, if given."""
    logs, popular = (context(spark, sf_dir), popularity_of_context(spark, sf_dir)) if given is None else (given, ranking.popularity(given))
    return ranking.candidates(*sources(logs, derived(spark, sf_dir, "item_vectors"), popular, DEPTH, wanted), DEPTH)


def held_out_ranks(spark, sf_dir):
    """The ranks of every held-out target among its user's candidates, a row a target; null where it isn't one. Written once a query."""
    return kept(spark, sf_dir, "held", _held_out_ranks)


def _held_out_ranks(spark, sf_dir, _name):
    targets = split(spark, sf_dir).where("role = 'test'").select("user_id", "film_id").join(strata(spark, sf_dir).select("film_id", "stratum"), "film_id")
    found = candidates_of_context(spark, sf_dir, wanted=targets.select("user_id", "film_id"))
    ranks = found.join(popularity_of_context(spark, sf_dir).select("film_id"), "film_id", "left_semi").select("user_id", "film_id", F.col("rrf_rank").alias("rank"), "svd_rank", "popularity_rank")
    return targets.join(ranks, ["user_id", "film_id"], "left").select("user_id", "film_id", "stratum", "rank", "svd_rank", "popularity_rank")


@query("leave_two_out", sql("SELECT user_id, film_id, rating, role FROM split"))
def leave_two_out(spark, sf_dir):
    return E.holdout(derived(spark, sf_dir, "logs")).select("user_id", "film_id", "rating", "role")


@query("user_folds", sql("""WITH c AS (SELECT t.user_id, t.film_id, coalesce(size, 0) AS size FROM (SELECT user_id, film_id FROM split WHERE role = 'test') t LEFT JOIN (SELECT user_id, count(*) AS size FROM split WHERE role = 'context' GROUP BY user_id) USING (user_id)),
    q AS (SELECT quantile_cont(size, 0.25) AS q0, quantile_cont(size, 0.5) AS q1, quantile_cont(size, 0.75) AS q2 FROM c), d AS (SELECT user_id, stratum, CAST(size >= q0 AS INT) + CAST(size >= q1 AS INT) + CAST(size >= q2 AS INT) AS depth FROM c, q, strata WHERE c.film_id = strata.film_id)
    SELECT user_id, depth, stratum, CAST((row_number() OVER (PARTITION BY depth, stratum ORDER BY md5(concat_ws(':', '42', CAST(user_id AS VARCHAR)))) + CASE stratum WHEN 'HEAD' THEN 0 WHEN 'MID' THEN 1 ELSE 2 END + depth) % 5 AS INT) AS fold FROM d"""))
def user_folds(spark, sf_dir):
    return E.folds(split(spark, sf_dir), strata(spark, sf_dir))


@query("fold_partitions", f"SELECT user_id, CASE fold WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS partition FROM ({ORACLES['user_folds']})")
def fold_partitions(spark, sf_dir):
    return E.partitions(user_folds(spark, sf_dir), 0)


@query("training_holdouts", sql(f"""WITH a AS (SELECT *, CASE WHEN rating >= 4.5 THEN 3 WHEN rating >= 4 THEN 2 ELSE 1 END AS label FROM split WHERE role = 'context' AND rating >= 3.5), b AS (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY {_KEY}) AS turn FROM a)
    SELECT user_id, film_id, label, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY turn, label) AS place FROM b) WHERE place <= 8"""))
def training_holdouts(spark, sf_dir):
    return E.training_holdouts(split(spark, sf_dir))


def _labels(spark, sf_dir):
    return split(spark, sf_dir).where("role <> 'context'").select("user_id", "film_id", F.lit(2).alias("label"))


def _open_candidates(spark, sf_dir):
    """Fused candidates and the labelled films, as an inventory to sample from."""
    rows = candidate_union(spark, sf_dir).select("user_id", "film_id", "membership", "popularity_rank")
    extra = _labels(spark, sf_dir).select("user_id", "film_id", F.lit("both").alias("membership"), F.lit(5).cast("bigint").alias("popularity_rank"))
    return rows.unionByName(extra)


def sampled_sql(cap: int) -> str:
    """The tables up to sampled, of candidates c(user_id, film_id, membership, popularity_rank) and labels l(user_id, film_id, label)."""
    steps = ", ".join(
        f"""s{i + 2} AS (SELECT * REPLACE (CASE WHEN tb IS NULL AND coalesce({cond}, false) AND row_number() OVER (PARTITION BY user_id, tb IS NULL AND coalesce({cond}, false) ORDER BY h) <= floor(room * {share}) THEN '{name}' ELSE tb END AS tb) FROM s{i + 1})"""
        for i, (name, share, cond) in enumerate((("both", 0.25, "membership = 'both'"), ("svd_only", 0.25, "membership = 'svd_only'"), ("popularity_only", 0.20, "membership = 'popularity_only'"), ("top", 0.125, "popularity_rank <= 500"), ("middle", 0.10, "popularity_rank BETWEEN 501 AND 2000")))
    )
    return f"""s0 AS (SELECT c.*, coalesce(label, 0) AS label, {_KEY.replace('user_id', 'c.user_id').replace('film_id', 'c.film_id')} AS h, CASE WHEN label > 0 THEN 'positive' END AS tb FROM c LEFT JOIN l USING (user_id, film_id)),
    s1 AS (SELECT *, {cap} - count(*) FILTER (tb = 'positive') OVER (PARTITION BY user_id) AS room FROM s0), {steps},
    s7 AS (SELECT *, count(tb) OVER (PARTITION BY user_id) AS have, row_number() OVER (PARTITION BY user_id, tb IS NULL ORDER BY h) AS p FROM s6),
    sampled AS (SELECT user_id, film_id, label, coalesce(tb, 'fill') AS taken_by FROM s7 WHERE tb IS NOT NULL OR p <= {cap} - have)"""


@query("negative_sample", sql(f"""WITH c AS (SELECT user_id, film_id, membership, popularity_rank FROM cand UNION ALL SELECT user_id, film_id, 'both', 5 FROM split WHERE role <> 'context'),
    l AS (SELECT user_id, film_id, 2 AS label FROM split WHERE role <> 'context'), {sampled_sql(100)} SELECT * FROM sampled"""))
def negative_sample(spark, sf_dir):
    return E.sampled_groups(_open_candidates(spark, sf_dir), _labels(spark, sf_dir), 100)


@query("target_rank", sql("SELECT t.user_id, t.film_id, CASE WHEN max(o.positives) IS NOT NULL THEN 1 + count(*) FILTER (p.positives > o.positives OR (p.positives = o.positives AND p.film_id < t.film_id)) END AS rank FROM (SELECT user_id, film_id FROM split WHERE role = 'test') t LEFT JOIN pop o USING (film_id) CROSS JOIN pop p GROUP BY t.user_id, t.film_id"))
def target_rank(spark, sf_dir):
    targets = split(spark, sf_dir).where("role = 'test'").select("user_id", "film_id")
    # All users share one order of the films, so the rank is the film's own.
    popular = ranking.popularity(derived(spark, sf_dir, "logs")).select("film_id", F.col("popularity_rank").alias("rank"))
    return targets.join(popular, "film_id", "left").select("user_id", "film_id", "rank")


_M = "count(*) AS targets, " + ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_{k}" for k in E.CUTOFFS) + ", " + ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END), 6) AS ndcg_{k}" for k in E.CUTOFFS[:2]) + ", round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr_10"


@query("ranking_metrics", sql(f"SELECT stratum, {_M} FROM held GROUP BY stratum"))
def ranking_metrics(spark, sf_dir):
    return E.metrics(held_out_ranks(spark, sf_dir), ["stratum"])


@query("metric_views", sql(f"WITH r AS (SELECT round(avg(CASE WHEN rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS candidate_recall FROM held) SELECT *, candidate_recall FROM (SELECT {_M}, 'global' AS \"view\" FROM held UNION ALL SELECT {_M}, 'conditional' FROM held WHERE rank IS NOT NULL), r".replace("SELECT *, candidate_recall FROM (", "SELECT * FROM (")))
def metric_views(spark, sf_dir):
    return E.views(held_out_ranks(spark, sf_dir))


@query("metric_segments", sql(f"SELECT 'stratum' AS segment, stratum AS value, {_M} FROM held GROUP BY stratum UNION ALL SELECT 'band', CAST(user_id % 3 AS VARCHAR), {_M} FROM held GROUP BY user_id % 3"))
def metric_segments(spark, sf_dir):
    return E.segments(held_out_ranks(spark, sf_dir).withColumn("band", F.col("user_id") % 3), ["stratum", "band"])


@query("graded_ndcg", sql("""WITH g AS (SELECT user_id, film_id, CASE WHEN rating >= 4.5 THEN 7 WHEN rating >= 4 THEN 3 WHEN rating >= 3.5 THEN 1 ELSE 0 END AS g, popularity_rank FROM logs JOIN pop USING (film_id) WHERE rating IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY popularity_rank) AS a, row_number() OVER (PARTITION BY user_id ORDER BY g DESC, film_id) AS b FROM g)
    SELECT user_id, round(CASE WHEN sum(CASE WHEN b <= 20 THEN g / log2(b + 1.0::DOUBLE) ELSE 0 END) > 0 THEN sum(CASE WHEN a <= 20 THEN g / log2(a + 1.0::DOUBLE) ELSE 0 END) / sum(CASE WHEN b <= 20 THEN g / log2(b + 1.0::DOUBLE) ELSE 0 END) ELSE 0 END, 6) AS ndcg FROM o GROUP BY user_id"""))
def graded_ndcg(spark, sf_dir):
    from marquee.functions.ratings import relevance

    logs = derived(spark, sf_dir, "logs").where("rating IS NOT NULL")
    rows = logs.join(ranking.popularity(derived(spark, sf_dir, "logs")), "film_id")
    return E.graded_ndcg(rows.select("user_id", "film_id", (-F.col("popularity_rank")).cast("double").alias("score"), relevance(F.col("rating")).alias("label")), 20)


@query("metrics_over_folds", sql(f"WITH f AS (SELECT stratum, user_id % 5 AS fold, {_M} FROM held GROUP BY stratum, user_id % 5) SELECT stratum, round(avg(recall_20), 6) AS recall_20_mean, round(stddev_pop(recall_20), 6) AS recall_20_std, round(avg(ndcg_20), 6) AS ndcg_20_mean, round(stddev_pop(ndcg_20), 6) AS ndcg_20_std FROM f GROUP BY stratum"))
def metrics_over_folds(spark, sf_dir):
    rows = E.metrics(held_out_ranks(spark, sf_dir).withColumn("fold", F.col("user_id") % 5), ["stratum", "fold"])
    return E.over_runs(rows, ["stratum"], ["recall_20", "ndcg_20"])


@query("catalog_coverage", sql("SELECT cutoff, count(DISTINCT film_id) AS films, round(count(DISTINCT film_id) / (SELECT count(*) FROM films)::DOUBLE, 6) AS share FROM ranked, (VALUES (10), (20), (50)) c(cutoff) WHERE rrf_rank <= cutoff GROUP BY cutoff"))
def catalog_coverage(spark, sf_dir):
    return E.coverage(inventory(spark, sf_dir).select("user_id", "film_id", F.col("rrf_rank").alias("rank")), derived(spark, sf_dir, "films").count())


@query("retrieved_popularity", sql("SELECT cutoff, round(avg(p), 6) AS mean_percentile, round(median(p), 6) AS median_percentile FROM ranked JOIN (SELECT film_id, 1 - percent_rank() OVER (ORDER BY popularity_rank) AS p FROM pop) USING (film_id), (VALUES (10), (20), (50)) c(cutoff) WHERE rrf_rank <= cutoff GROUP BY cutoff"))
def retrieved_popularity(spark, sf_dir):
    return E.retrieved_popularity(inventory(spark, sf_dir).select("user_id", "film_id", F.col("rrf_rank").alias("rank")), strata(spark, sf_dir))


@query("mean_jaccard", sql("WITH u AS (SELECT DISTINCT user_id FROM logs), b AS (SELECT coalesce(s.user_id, p.user_id) AS user_id, s.film_id AS x, p.film_id AS y FROM (SELECT * FROM svd WHERE svd_rank <= 50) s FULL JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY popularity_rank) AS pl FROM popcand) WHERE pl <= 50) p ON s.user_id = p.user_id AND s.film_id = p.film_id), j AS (SELECT user_id, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / count(*) AS j FROM b GROUP BY user_id) SELECT round(avg(coalesce(j, 1)), 6) AS jaccard FROM u LEFT JOIN j USING (user_id)"))
def mean_jaccard(spark, sf_dir):
    rows = candidate_union(spark, sf_dir)
    logs = kept(spark, sf_dir, "logs")
    top = ranking.popularity_candidates(logs, ranking.popularity(logs), 50)
    return E.mean_jaccard(rows.where("svd_rank <= 50"), top, logs.select("user_id").distinct())


@query("hit_attribution", sql("WITH c AS (SELECT svd_rank IS NOT NULL AS svd, popularity_rank IS NOT NULL AS popularity, coalesce(rank <= 50, false) AS third FROM held) SELECT svd, popularity, third, count(*) AS targets, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM c GROUP BY svd, popularity, third"))
def hit_attribution(spark, sf_dir):
    rows = held_out_ranks(spark, sf_dir)
    return E.hit_attribution(rows.select("user_id", "film_id"), {n: rows.where(c).select("user_id", "film_id") for n, c in (("svd", "svd_rank IS NOT NULL"), ("popularity", "popularity_rank IS NOT NULL"), ("third", "rank <= 50"))})


_SWEEP = "sweep AS (SELECT budget, ratio, round(avg(CASE WHEN coalesce(a <= round(budget * ratio) OR b <= budget - round(budget * ratio), false) THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall FROM (SELECT svd_rank AS a, popularity_rank AS b FROM held), (VALUES (50), (100), (200), (400)) x(budget), (VALUES (0.2::DOUBLE), (0.5::DOUBLE), (0.8::DOUBLE)) y(ratio) GROUP BY budget, ratio)"


def _sweep(spark, sf_dir):
    rows = held_out_ranks(spark, sf_dir)
    return E.allocation_sweep(rows.select("svd_rank", "popularity_rank"), [50, 100, 200, 400], [0.2, 0.5, 0.8])


@query("allocation_sweep", sql(f"WITH {_SWEEP} SELECT budget, ratio, recall FROM sweep"))
def allocation_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir)


@query("near_winners", sql(f"WITH {_SWEEP} SELECT budget, ratio, recall, ratio IN (0.2::DOUBLE, 0.8::DOUBLE) AS edge FROM (SELECT *, max(recall) OVER (PARTITION BY budget) AS best FROM sweep) WHERE recall >= best - 0.005"))
def near_winners(spark, sf_dir):
    return E.near_winners(_sweep(spark, sf_dir))


@query("marginal_value", sql(f"WITH {_SWEEP} SELECT budget, recall, round(recall - lag(recall) OVER (ORDER BY budget), 6) AS gain FROM (SELECT budget, max(recall) AS recall FROM sweep GROUP BY budget)"))
def marginal_value(spark, sf_dir):
    return E.marginal_value(_sweep(spark, sf_dir))


@query("chosen_budget", sql(f"WITH {_SWEEP}, m AS (SELECT budget, round(recall - lag(recall) OVER (ORDER BY budget), 6) AS gain FROM (SELECT budget, max(recall) AS recall FROM sweep GROUP BY budget)) SELECT coalesce(min(budget) FILTER (budget >= 100 AND gain < 0.02), max(budget) FILTER (budget <= 400)) AS budget FROM m"))
def chosen_budget(spark, sf_dir):
    return E.chosen_budget(E.marginal_value(_sweep(spark, sf_dir)), least=100, most=400)


@query("bootstrap_interval")
def bootstrap_interval(spark, sf_dir):
    rows = held_out_ranks(spark, sf_dir).groupBy("user_id").agg(F.avg(F.when(F.col("rank") <= 20, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("delta"))
    return E.bootstrap(rows, 1000)


@query("metric_correlation", sql("SELECT round(corr(a, b), 6) AS correlation FROM (SELECT avg(rating) AS a, CAST(count(*) AS DOUBLE) AS b FROM logs GROUP BY user_id)"))
def metric_correlation(spark, sf_dir):
    return E.correlation(derived(spark, sf_dir, "logs").groupBy("user_id").agg(F.avg("rating").alias("a"), F.count("*").cast("double").alias("b")), "a", "b")


@query("biggest_movers", sql("WITH r AS (SELECT user_id, film_id, svd_rank - rank AS change FROM held WHERE rank IS NOT NULL AND svd_rank IS NOT NULL) SELECT * FROM (SELECT 'improved' AS direction, user_id, film_id, change FROM r ORDER BY change, user_id, film_id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'worsened', user_id, film_id, change FROM r ORDER BY change DESC, user_id, film_id LIMIT 10)"))
def biggest_movers(spark, sf_dir):
    a = held_out_ranks(spark, sf_dir)
    return E.movers(a, a.withColumn("rank", F.col("svd_rank")))


@query("film_aggregates", sql("SELECT film_id, count(*) AS n, round(avg(rating), 6) AS mean, round(greatest(sum(rating * rating) / count(*) - (sum(rating) / count(*)) * (sum(rating) / count(*)), 0), 6) AS variance, count(*) FILTER (rating >= 3.5) AS positive, count(*) FILTER (rating <= 2.5) AS negative, round((sum(rating) + 20 * any_value(mu)) / (count(*) + 20), 6) AS smoothed FROM logs, (SELECT avg(rating) AS mu FROM logs) WHERE rating IS NOT NULL GROUP BY film_id"))
def film_aggregates(spark, sf_dir):
    return E.film_aggregates(derived(spark, sf_dir, "logs"))


@query("user_features", sql("SELECT user_id, count(*) AS rated, round(ln(1 + count(*)::DOUBLE), 6) AS log_rated, round(avg(rating), 6) AS mean, round(var_pop(rating), 6) AS variance, round(stddev_pop(rating), 6) AS deviation, round(avg(CASE WHEN rating >= 3.5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS positive_fraction, round(avg(CASE WHEN rating <= 2.5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS negative_fraction, round(avg(CASE WHEN rating >= 4.5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS high_fraction, max(rating) - min(rating) AS range FROM logs WHERE rating IS NOT NULL GROUP BY user_id"))
def user_features(spark, sf_dir):
    return E.user_features(derived(spark, sf_dir, "logs"))


ORACLE["raff"] = "SELECT user_id, family, entity_id, round(sum(rating - 3.0) / (count(*) + 5.0::DOUBLE), 6) AS affinity, count(*) AS support FROM logs JOIN film_entity USING (film_id) WHERE rating IS NOT NULL GROUP BY user_id, family, entity_id"


@query("ranker_affinity", sql("SELECT * FROM raff"))
def ranker_affinity(spark, sf_dir):
    return E.ranker_affinity(kept(spark, sf_dir, "logs"), derived(spark, sf_dir, "film_entity"))


@query("candidate_affinity", sql("SELECT c.user_id, c.film_id, family, round(CAST(sum(CAST(coalesce(affinity, 0) AS DECIMAL(18, 6))) AS DOUBLE) / count(*), 9) AS mean, max(coalesce(affinity, 0)) AS best, min(coalesce(affinity, 0)) AS worst, CAST(coalesce(sum(support), 0) AS BIGINT) AS support, count(affinity) AS matched, round(count(affinity) / count(*), 6) AS matched_fraction FROM popcand c JOIN film_entity USING (film_id) LEFT JOIN raff USING (user_id, family, entity_id) GROUP BY c.user_id, c.film_id, family"))
def candidate_affinity(spark, sf_dir):
    logs, entity = kept(spark, sf_dir, "logs"), kept(spark, sf_dir, "film_entity")
    return E.popular_affinity(ranking.watched_places(logs, ranking.popularity(logs), 200), 200, entity, E.ranker_affinity(logs, entity))


@query("weighted_year", sql("WITH s AS (SELECT user_id, sum(rating - 3) AS w, sum((rating - 3) * year::DOUBLE) AS wx, sum((rating - 3) * year::DOUBLE * year) AS wxx FROM logs JOIN films USING (film_id) WHERE rating > 3 GROUP BY user_id) SELECT user_id, round(wx / w, 4) AS mean, round(sqrt(greatest(wxx / w - (wx / w) * (wx / w), 0)), 4) AS deviation FROM s"))
def weighted_year(spark, sf_dir):
    return E.weighted_preferences(derived(spark, sf_dir, "logs"), derived(spark, sf_dir, "films"), "year")


@query("retraining_decision", sql("SELECT greatest(0, u - 1400) AS user_delta, i - 50000 AS interaction_delta, nf AS new_films, 12.5::DOUBLE AS age_days, array_to_string(list_filter([CASE WHEN u - 1400 >= 100 THEN 'users' END, CASE WHEN nf >= 250 THEN 'films' END], lambda x: x IS NOT NULL), ',') AS reasons FROM (SELECT count(DISTINCT user_id) AS u, count(*) AS i, count(DISTINCT film_id) FILTER (film_id % 2 = 1) AS nf FROM logs WHERE rating IS NOT NULL)"))
def retraining_decision(spark, sf_dir):
    logs = derived(spark, sf_dir, "logs")
    base = spark.createDataFrame([(1400, 50000, 12.5)], "users bigint, interactions bigint, age_days double")
    return E.retraining_decision(logs, logs.where("film_id % 2 = 0").select("film_id").distinct(), base).withColumn("reasons", F.array_join("reasons", ","))


@query("leakage_audit", sql("SELECT 0::BIGINT AS leaked"))
def leakage_audit(spark, sf_dir):
    rows = split(spark, sf_dir)
    return quality.leaked(rows.where("role <> 'context'"), rows.where("role = 'context'"), ["user_id", "film_id"])


@query("universe_audit", sql("SELECT (SELECT count(DISTINCT film_id) FROM logs) AS left_keys, (SELECT count(DISTINCT film_id) FROM item_vectors) AS right_keys, (SELECT count(DISTINCT film_id) FROM logs WHERE film_id NOT IN (SELECT film_id FROM item_vectors)) AS left_only, (SELECT count(DISTINCT film_id) FROM item_vectors WHERE film_id NOT IN (SELECT film_id FROM logs)) AS right_only"))
def universe_audit(spark, sf_dir):
    return quality.universe_audit(derived(spark, sf_dir, "logs"), derived(spark, sf_dir, "item_vectors"), "film_id")
