"""The analysis of candidate sources over seeds."""

from __future__ import annotations

from marquee.operators import candidates as C
from marquee.plans.core import DEPTH, sql
from marquee.plans.registry import query
from marquee.plans.runs import SEEDS, folds_sql
from marquee.sources import files
from marquee.sources.bridge import derived
from marquee.sources.runs import RunTable
from marquee.sources.work import folder, saved

BUDGETS = [50, 100, 200]
RATIOS = [0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2]
LEAST, MOST = 100, 200


def candidate_rows(spark, sf_dir, path, seeds=SEEDS):
    """Candidates and targets of all seeds in a run table at path; seeds that are there already aren't computed again."""
    if not seeds or len(set(seeds)) != len(seeds):
        raise ValueError("seeds are to be given, and each once")
    logs, items = saved(derived(spark, sf_dir, "logs")), derived(spark, sf_dir, "item_vectors")
    return RunTable(spark, path).fill(seeds, lambda seed: C.seed_pass(logs, items, seed, DEPTH))


def candidate_analysis(spark, sf_dir, path, seeds=SEEDS):
    """Runs the analysis: the run table at <path>/runs, the nested report as JSON at <path>/report; returns the report's rows."""
    rows = saved(C.report(candidate_rows(spark, sf_dir, f"{path}/runs", seeds), BUDGETS, RATIOS, LEAST, MOST))
    files.write_report(C.document(rows), f"{path}/report")
    return rows


def _stats(values: list[str]) -> str:
    return ", ".join(f"round({f}({v}), 6) AS {v}_{s}" for v in values for f, s in (("avg", "mean"), ("stddev_pop", "std")))


def _long(section: str, name: str, values: list[str], source: str) -> str:
    return f"SELECT '{section}' AS section, {name} AS name, unnest([{', '.join(repr(v) for v in values)}]) AS metric, unnest([{', '.join(f'CAST({v} AS DOUBLE)' for v in values)}]) AS value FROM {source}"


def _over(section: str, name: str, values: list[str], source: str, by: str) -> str:
    return _long(section, name, [f"{v}_{s}" for v in values for s in ("mean", "std")], f"(SELECT {by}, {_stats(values)} FROM {source} GROUP BY {by})")


_NAMES = ["recall_10", "recall_20", "recall_50", "ndcg_20", "mrr_10"]
_METRICS = "count(*) AS targets, " + ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_{k}" for k in (10, 20, 50)) + ", round(avg(CASE WHEN rank <= 20 THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END), 6) AS ndcg_20, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr_10"
_GRID = ", ".join(f"({b}, {round(b * r)})" for b in BUDGETS for r in RATIOS)
_SQL = folds_sql(SEEDS) + f"""c_p AS MATERIALIZED (SELECT seed, film_id, place, CASE WHEN place <= ceil(films * 0.10) THEN 'HEAD' WHEN place <= ceil(films * 0.50) THEN 'MID' ELSE 'TAIL' END AS stratum, 1 - (place - 1)::DOUBLE / (films - 1) AS percentile
 FROM (SELECT seed, film_id, row_number() OVER (PARTITION BY seed ORDER BY coalesce(n, 0) DESC, film_id) AS place, count(*) OVER (PARTITION BY seed) AS films FROM (SELECT DISTINCT film_id FROM logs) CROSS JOIN seeds LEFT JOIN (SELECT seed, film_id, count(*) AS n FROM r_ctx WHERE rating >= 3.5 GROUP BY ALL) USING (seed, film_id))),
c_t AS MATERIALIZED (SELECT seed, user_id, film_id FROM r_split WHERE role = 'test'),
c_s AS (SELECT seed, user_id, film_id, svd_rank FROM (SELECT *, row_number() OVER (PARTITION BY seed, user_id ORDER BY s DESC, film_id) AS svd_rank FROM (SELECT seed, user_id, film_id, round(list_inner_product(u, vec::DOUBLE[]), 6) AS s FROM (SELECT * FROM r_vec SEMI JOIN c_t USING (seed, user_id)) v CROSS JOIN (SELECT * FROM item_vectors SEMI JOIN logs USING (film_id)) i WHERE u[1] IS NOT NULL) c ANTI JOIN r_ctx USING (seed, user_id, film_id)) WHERE svd_rank <= {DEPTH}),
c_o AS (SELECT seed, user_id, film_id, popularity_rank FROM (SELECT *, row_number() OVER (PARTITION BY seed, user_id ORDER BY place) AS popularity_rank FROM (SELECT t.seed, t.user_id, p.film_id, place FROM c_t t JOIN c_p p USING (seed)) ANTI JOIN r_ctx USING (seed, user_id, film_id)) WHERE popularity_rank <= {DEPTH}),
c_b AS (SELECT seed, user_id, film_id, svd_rank, popularity_rank FROM c_s FULL JOIN c_o USING (seed, user_id, film_id)),
c_r AS MATERIALIZED (SELECT seed, user_id, film_id, svd_rank, popularity_rank, coalesce(target, false) AS target, stratum, percentile FROM c_b FULL JOIN (SELECT *, true AS target FROM c_t) USING (seed, user_id, film_id) JOIN c_p USING (seed, film_id)),
c_l AS (SELECT seed, user_id, film_id, target, stratum, percentile, 'svd' AS source, svd_rank AS rank FROM c_r UNION ALL SELECT seed, user_id, film_id, target, stratum, percentile, 'popularity', popularity_rank FROM c_r),
c_v AS (SELECT seed, source, 'all' AS view, {_METRICS} FROM c_l WHERE target GROUP BY seed, source UNION ALL SELECT seed, source, 'served', {_METRICS} FROM (SELECT * FROM c_l WHERE target) SEMI JOIN (SELECT seed, user_id, source FROM c_l WHERE rank IS NOT NULL) USING (seed, user_id, source) GROUP BY seed, source),
c_g AS (SELECT seed, source, stratum, {_METRICS} FROM c_l WHERE target GROUP BY ALL),
c_k AS (SELECT seed, source, cutoff, count(DISTINCT film_id) AS films, round(avg(percentile), 6) AS mean_percentile, round(median(percentile), 6) AS median_percentile FROM c_l, (SELECT unnest([10, 20, 50]) AS cutoff) WHERE rank <= cutoff GROUP BY ALL),
c_j AS (SELECT seed, cutoff, round(avg(j), 6) AS jaccard FROM (SELECT seed, user_id, cutoff, coalesce(count(*) FILTER (svd_rank <= cutoff AND popularity_rank <= cutoff)::DOUBLE / nullif(count(*) FILTER (svd_rank <= cutoff OR popularity_rank <= cutoff), 0), 1) AS j FROM c_r, (SELECT unnest([10, 20, 50]) AS cutoff) GROUP BY ALL) GROUP BY ALL),
c_f AS (SELECT seed, found, round(avg((found = own)::INT), 6) AS share FROM (SELECT seed, CASE WHEN svd_rank IS NOT NULL AND popularity_rank IS NOT NULL THEN 'both' WHEN svd_rank IS NOT NULL THEN 'svd_only' WHEN popularity_rank IS NOT NULL THEN 'popularity_only' ELSE 'missed' END AS own FROM c_r WHERE target), (SELECT unnest(['both', 'svd_only', 'popularity_only', 'missed']) AS found) GROUP BY ALL),
c_c AS (SELECT *, depth AS a, budget - depth AS b FROM (VALUES {_GRID}) g(budget, depth) UNION ALL SELECT unnest({BUDGETS}), NULL, unnest({BUDGETS}), unnest({BUDGETS})),
c_n AS (SELECT seed, count(DISTINCT user_id) AS users, count(*) FILTER (target) AS targets FROM c_r GROUP BY seed),
c_w AS MATERIALIZED (SELECT seed, budget, depth, round(count(*) FILTER (target)::DOUBLE / any_value(targets), 6) AS recall, round(count(*)::DOUBLE / any_value(users), 6) AS mean_size FROM c_r JOIN c_n USING (seed) JOIN c_c ON svd_rank <= a OR popularity_rank <= b GROUP BY seed, budget, depth),
c_a AS (SELECT budget, depth, {_stats(["recall", "mean_size"])} FROM c_w WHERE depth IS NOT NULL GROUP BY ALL),
c_x AS (SELECT *, row_number() OVER (PARTITION BY budget ORDER BY recall_mean DESC, recall_std, depth DESC) = 1 AS chosen, round(max(recall_mean) OVER (PARTITION BY budget) - recall_mean, 6) <= 0.005 AS near, depth = min(depth) OVER (PARTITION BY budget) OR depth = max(depth) OVER (PARTITION BY budget) AS edge FROM c_a),
c_m AS (SELECT budget, depth, recall_mean AS recall, round(recall_mean - lag(recall_mean) OVER (ORDER BY budget), 6) AS gain FROM c_x WHERE chosen),
c_z AS (SELECT budget, depth AS svd_depth, budget - depth AS popularity_depth, recall, coalesce(gain < 0.02 AND budget >= {LEAST}, false) AS measured FROM c_m WHERE budget = (SELECT coalesce(min(budget) FILTER (budget >= {LEAST} AND gain < 0.02), max(budget) FILTER (budget <= {MOST})) FROM c_m))
""" + " UNION ALL ".join([
    _over("source", "source || '/' || view", _NAMES, "c_v", "source, view"),
    _over("stratum", "source || '/' || stratum", ["targets", "recall_20", "ndcg_20"], "c_g", "source, stratum"),
    _over("reach", "source || '/' || cutoff", ["films", "mean_percentile", "median_percentile"], "c_k", "source, cutoff"),
    _over("overlap", "cutoff::VARCHAR", ["jaccard"], "c_j", "cutoff"),
    _over("found", "found", ["share"], "c_f", "found"),
    _long("union", "budget::VARCHAR", ["recall_mean", "recall_std", "mean_size_mean"], f"(SELECT budget, {_stats(['recall', 'mean_size'])} FROM c_w WHERE depth IS NULL GROUP BY budget)"),
    _long("allocation", "budget || '/' || depth", ["recall_mean", "recall_std", "mean_size_mean", "chosen::INT", "near::INT", "edge::INT"], "c_x").replace("'chosen::INT', 'near::INT', 'edge::INT'", "'chosen', 'near', 'edge'"),
    _long("step", "budget::VARCHAR", ["recall", "gain"], "c_m"),
    _long("recommended", "''", ["budget", "svd_depth", "popularity_depth", "recall", "measured::INT"], "c_z").replace("'measured::INT'", "'measured'"),
])


@query("candidate_analysis", sql(_SQL))
def candidate_analysis_report(spark, sf_dir):
    """Vector and popularity candidates over 3 seeds: metrics, reach, overlap, allocations of a budget and the recommended one."""
    return candidate_analysis(spark, sf_dir, folder(spark))
