"""Candidate sources over seeds against plain Python, resampling of users, ranks with one common value."""

import json
import random
import statistics
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import candidates as C
from marquee.operators import evaluation as E
from marquee.operators import quality, ranking
from marquee.plans import candidates as plans
from marquee.sources import files

SCHEMA = "seed int, user_id long, film_id long, svd_rank long, popularity_rank long, target boolean, stratum string, percentile double"
FILMS, BUDGETS, RATIOS = 40, [4, 8, 12], [0.75, 0.5, 0.25]


@pytest.fixture(scope="module")
def rows():
    """Candidates of 3 seeds: user 0 is served by popularity only, user 1 by none, targets may be missed."""
    r, out = random.Random(5), []
    for seed in (1, 2, 3):
        for u in range(12):
            svd, popular = (r.sample(range(FILMS), 12) for _ in range(2))
            svd, popular = ([] if u < 2 else svd), ([] if u == 1 else popular)
            target = r.randrange(FILMS)
            for f in {*svd, *popular, target}:
                a, b = (x.index(f) + 1 if f in x else None for x in (svd, popular))
                out.append((seed, u, f, a, b, f == target, "HEAD" if f < 4 else "MID" if f < 20 else "TAIL", 1 - f / (FILMS - 1)))
    return out


def _mean(values):
    return round(statistics.fmean(values), 6)


def test_report_equals_plain_python(spark, rows):
    got = {(r.section, r.name, r.metric): r.value for r in C.report(spark.createDataFrame(rows, SCHEMA), BUDGETS, RATIOS, 8, 12).collect()}
    want, seeds = {}, (1, 2, 3)
    at = {s: [r for r in rows if r[0] == s] for s in seeds}
    for i, source in ((3, "svd"), (4, "popularity")):
        for view in ("all", "served"):
            recalls = []
            for s in seeds:
                served = {r[1] for r in at[s] if r[i] is not None}
                ranks = [r[i] for r in at[s] if r[5] and (view == "all" or r[1] in served)]
                recalls.append(round(sum(k is not None and k <= 10 for k in ranks) / len(ranks), 6))
            want["source", f"{source}/{view}", "recall_10_mean"] = _mean(recalls)
            want["source", f"{source}/{view}", "recall_10_std"] = round(statistics.pstdev(recalls), 6)
        lists = {s: [(r[2], r[7]) for r in at[s] if r[i] is not None and r[i] <= 10] for s in seeds}
        want["reach", f"{source}/10", "films_mean"] = _mean([len(set(x)) for x in lists.values()])
        want["reach", f"{source}/10", "mean_percentile_mean"] = _mean([_mean([p for _, p in x]) for x in lists.values()])
        want["reach", f"{source}/10", "median_percentile_mean"] = _mean([round(statistics.median([p for _, p in x]), 6) for x in lists.values()])
    alike = []
    for s in seeds:
        each = []
        for u in range(12):
            a, b = ({r[2] for r in at[s] if r[1] == u and r[i] is not None and r[i] <= 10} for i in (3, 4))
            each.append(len(a & b) / len(a | b) if a | b else 1.0)
        alike.append(_mean(each))
    want["overlap", "10", "jaccard_mean"] = _mean(alike)
    kinds = {s: Counter("both" if r[3] and r[4] else "svd_only" if r[3] else "popularity_only" if r[4] else "missed" for r in at[s] if r[5]) for s in seeds}
    for kind in ("both", "svd_only", "popularity_only", "missed"):
        want["found", kind, "share_mean"] = _mean([round(kinds[s][kind] / 12, 6) for s in seeds])
    best = {}
    for b in BUDGETS:
        grid = {}
        for d, e, name in [(round(b * q), b - round(b * q), f"{b}/{round(b * q)}") for q in RATIOS] + [(b, b, str(b))]:
            hit = {s: [r for r in at[s] if (r[3] or 99) <= d or (r[4] or 99) <= e] for s in seeds}
            recall = [round(sum(r[5] for r in hit[s]) / 12, 6) for s in seeds]
            section = "union" if name == str(b) else "allocation"
            want[section, name, "recall_mean"], want[section, name, "mean_size_mean"] = _mean(recall), _mean([round(len(hit[s]) / 12, 6) for s in seeds])
            if section == "allocation":
                grid[d] = (_mean(recall), -round(statistics.pstdev(recall), 6), d)
        top = max(grid.values())
        best[b] = top
        for d, cell in grid.items():
            want["allocation", f"{b}/{d}", "chosen"] = float(cell == top)
            want["allocation", f"{b}/{d}", "near"] = float(round(top[0] - cell[0], 6) <= 0.005)
            want["allocation", f"{b}/{d}", "edge"] = float(d in (min(grid), max(grid)))
    gain = {b: round(best[b][0] - best[a][0], 6) for a, b in zip(BUDGETS, BUDGETS[1:])}
    flat = [b for b in (8, 12) if gain[b] < 0.02]
    budget = flat[0] if flat else 12
    want |= {("recommended", "", "budget"): budget, ("recommended", "", "svd_depth"): best[budget][2], ("recommended", "", "popularity_depth"): budget - best[budget][2], ("recommended", "", "recall"): best[budget][0], ("recommended", "", "measured"): float(bool(flat))}
    for key, value in want.items():
        assert got[key] == pytest.approx(value, abs=2e-6), key
    assert got["step", "4", "gain"] is None and got["step", "12", "gain"] == pytest.approx(gain[12], abs=2e-6)


def test_report_of_nothing(spark):
    got = C.report(spark.createDataFrame([], SCHEMA), BUDGETS, RATIOS, 8, 12).collect()
    assert all(r.value is None for r in got) and {r.section for r in got} <= {"recommended"}


def test_seeds_are_given_once(spark, sf):
    for seeds in ((), (1, 1)):
        with pytest.raises(ValueError):
            plans.candidate_rows(spark, sf, "unused", seeds)


def test_analysis_resumes_and_writes_its_report(spark, sf, tmp_path):
    rows = plans.candidate_rows(spark, sf, str(tmp_path / "runs"), (42,))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "runs" / "42").iterdir()}
    logs = plans.derived(spark, sf, "logs")
    context = E.holdout(logs, 42).where("role = 'context'")
    assert rows.where("NOT target").join(context, ["user_id", "film_id"], "left_semi").count() == 0
    assert rows.where("target").count() == rows.select("user_id").distinct().count() > 100
    assert rows.groupBy("user_id").agg(F.max("svd_rank").alias("a"), F.count("svd_rank").alias("b")).where("a <> b").count() == 0
    got = plans.candidate_analysis(spark, sf, str(tmp_path), (42, 43))
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    want = {(r.section, r.name, r.metric): r.value for r in got.collect()}
    read = {}
    for part in (tmp_path / "report").glob("*.json"):
        for line in part.read_text().splitlines():
            d = json.loads(line)
            read |= {(d["section"], name, m): v for name, values in d["entries"].items() for m, v in values.items()}
    assert {k: v for k, v in want.items() if v is not None} == {k: v for k, v in read.items() if v is not None}


def test_reports_replace_earlier_ones(spark, tmp_path):
    path = str(tmp_path / "r")
    for n in (1, 2):
        files.write_report(spark.createDataFrame([(n, {"a": n / 2})], "n int, values map<string,double>"), path)
    assert [json.loads(x) for p in Path(path).glob("*.json") for x in p.read_text().splitlines()] == [{"n": 2, "values": {"a": 1.0}}]


@pytest.mark.parametrize("users", [1, 5, 1024, 1025, 5000])
def test_every_replicate_draws_as_many_users_as_there_are(users):
    blocks = -(-users // E.BLOCK)
    draws = np.array([E._draws(7, 200, users, b) for b in range(blocks)])
    assert (draws.sum(axis=0) == users).all() and (draws >= 0).all()
    if users == 5000:  # a block's share is binomial
        assert abs(draws[0].mean() - 1024) < 15 and 0.7 < draws[0].std() / np.sqrt(5000 * 0.2048 * 0.7952) < 1.3


def test_bootstrap_is_that_of_numpy(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0.1, 1, 1500), rng.exponential(3, 200)])
    rows = [(int(i) - 300, float(v)) for i, v in enumerate(values)] + [(9999, None)]
    table = spark.createDataFrame(rows, "user_id long, delta double")
    got = E.bootstrap(table.repartition(7), 2000).first()
    again = E.bootstrap(table.coalesce(1).orderBy(F.desc("delta")), 2000).first()
    assert (got.low, got.high) == pytest.approx((again.low, again.high), abs=1e-12)
    means = values[rng.integers(0, len(values), (2000, len(values)))].mean(axis=1)
    assert got.users == 1700 and got["mean"] == pytest.approx(values.mean())
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])), abs=0.02)
    flat = E.bootstrap(table.select("user_id", F.lit(0.5).alias("delta")), 50).first()
    assert (flat.low, flat.high) == (0.5, 0.5)
    one = E.bootstrap(spark.createDataFrame([(None, 2.0)], "user_id long, delta double"), 50).first()
    assert tuple(one) == (1, 2.0, 2.0, 2.0)
    assert tuple(E.bootstrap(table.limit(0), 50).first()) == (0, None, None, None)


def test_ranks_of_one_common_value(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SPAN", 3)
    r = random.Random(2)
    rows = [(i - 20, r.choice([0, 0, 0, 0, 5, None, 7])) for i in range(150)]
    got = {x.film_id: x["rank"] for x in ranking.rank_by_value(spark.createDataFrame(rows, "film_id long, n long"), "n", "film_id").collect()}
    order = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert got == {f: i + 1 for i, (f, _) in enumerate(order)}


def test_numbers_of_skewed_ids(spark):
    ids = [*range(500), 10**15, 10**17, -(10**12)]
    got = {x.id: x.number for x in quality.numbered(spark.createDataFrame([(i,) for i in ids], "id long"), "id").collect()}
    assert got == {x: i + 1 for i, x in enumerate(sorted(ids))}
    assert quality.numbered(spark.createDataFrame([], "id long"), "id").count() == 0
