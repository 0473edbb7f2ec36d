"""Queries of training examples, ranking datasets, shelf recall and policy variants."""

from __future__ import annotations

import dataclasses
import functools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import reasons
from marquee.operators import evaluation as E
from marquee.operators import features as X
from marquee.operators import preferences, ranking, training, vectors
from marquee.plans.core import DEPTH, NAMED, ORACLE, POLICY, SHELF_SQL, inventory, parts, proposed, shelf_of, sql
from marquee.plans.evaluation import _CONTEXT, _KEY, _M, candidates_of_context, sampled_sql, split
from marquee.plans.registry import query
from marquee.sources.bridge import derived
from marquee.sources.work import saved

_LABEL = "CASE WHEN rating >= 4.5 THEN 3 WHEN rating >= 4 THEN 2 ELSE 1 END"
_PAIR = "md5(concat_ws(':', '42', CAST(user_id AS VARCHAR), CAST(positive_id AS VARCHAR), CAST({} AS VARCHAR)))"
ORACLE["hold"] = f"""SELECT user_id, film_id, label FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY turn, label) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY {_KEY}) AS turn
    FROM (SELECT *, {_LABEL} AS label FROM split WHERE role = 'context' AND rating >= 3.5))) WHERE place <= 8"""
ORACLE["tctx"] = "SELECT user_id, film_id, rating FROM split WHERE role = 'context' AND (user_id, film_id) NOT IN (SELECT (user_id, film_id) FROM hold)"


def _renamed(text: str, names: list[str], mark: str, logs: str) -> str:
    return re.sub(rf"\b(logs|{'|'.join(names)})\b", lambda m: logs if m[0] == "logs" else f"{mark}_{m[0]}", text)


#: The tables up to the fused candidates from the training context, and the shelves from the context.
_SHELVED = [*_CONTEXT, "prof", "prefs", "good", "topent", "anc", "shelved"]
ORACLE |= {f"t_{n}": _renamed(ORACLE[n], _CONTEXT, "t", "tctx") for n in _CONTEXT}
ORACLE |= {f"c_{n}": _renamed(ORACLE[n], _SHELVED, "c", "ctx") for n in _SHELVED}


@query("pairwise_examples", sql(f"""WITH c AS (SELECT user_id, film_id, rating FROM split WHERE role = 'context'),
    picks AS (SELECT user_id, film_id AS positive_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_KEY}) AS p FROM c WHERE rating >= 3.5) WHERE p <= 4),
    b AS (SELECT *, {_PAIR.format('film_id')} AS h FROM (SELECT picks.user_id, positive_id, film_id, rating FROM picks JOIN c ON c.user_id = picks.user_id AND film_id <> positive_id)),
    un AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY film_id) AS j, count(*) OVER (PARTITION BY user_id) AS free FROM (SELECT u.user_id, v.film_id FROM (SELECT DISTINCT user_id FROM split) u CROSS JOIN (SELECT DISTINCT film_id FROM item_vectors) v WHERE (u.user_id, v.film_id) NOT IN (SELECT (user_id, film_id) FROM split))),
    need AS (SELECT user_id, positive_id, free, need, unnest(range(need)) AS turn FROM (SELECT user_id, positive_id, 4 - least(count(*) FILTER (rating <= 2.5), 2) AS need FROM b GROUP BY user_id, positive_id) JOIN (SELECT user_id, max(free) AS free FROM un GROUP BY user_id) USING (user_id)),
    d AS (SELECT *, (turn * free) // need + ('0x' || substr({_PAIR.format('turn')}, 1, 8))::BIGINT % greatest(((turn + 1) * free) // need - (turn * free) // need, 1) + 1 AS j FROM need)
    SELECT user_id, positive_id, 'context' AS part, turn, film_id, rating FROM (SELECT *, row_number() OVER (PARTITION BY user_id, positive_id ORDER BY h) AS turn FROM b) WHERE turn <= 50
    UNION ALL SELECT user_id, positive_id, 'low', turn, film_id, rating FROM (SELECT *, row_number() OVER (PARTITION BY user_id, positive_id ORDER BY h) AS turn FROM b WHERE rating <= 2.5) WHERE turn <= 2
    UNION ALL SELECT d.user_id, positive_id, 'unseen', turn + 1, un.film_id, NULL FROM d JOIN un ON un.user_id = d.user_id AND un.j = d.j"""))
def pairwise_examples(spark, sf_dir):
    return training.pairwise_examples(split(spark, sf_dir), derived(spark, sf_dir, "item_vectors"))


def _examples(spark, sf_dir, partition: str) -> DataFrame:
    rows = split(spark, sf_dir)
    return training.user_examples(rows, E.training_holdouts(rows), partition)


@query("user_examples_train", sql("SELECT user_id, film_id, 'context' AS kind, CAST(NULL AS INT) AS label, rating FROM tctx UNION ALL SELECT user_id, film_id, 'positive', label, NULL FROM hold UNION ALL SELECT user_id, film_id, 'forbidden', NULL, NULL FROM split WHERE role <> 'context'"))
def user_examples_train(spark, sf_dir):
    return _examples(spark, sf_dir, "train")


@query("user_examples_validation", sql(f"SELECT user_id, film_id, CASE role WHEN 'context' THEN 'context' WHEN 'validation' THEN 'positive' ELSE 'forbidden' END AS kind, CASE WHEN role = 'validation' THEN {_LABEL} END AS label, CASE WHEN role = 'context' THEN rating END AS rating FROM split"))
def user_examples_validation(spark, sf_dir):
    return _examples(spark, sf_dir, "validation")


_RANKS = "r.svd_rank, r.popularity_rank, r.rrf_rank"


@query("ranking_dataset_train", sql(f"""WITH c AS (SELECT user_id, film_id, membership, popularity_rank FROM t_ranked WHERE (user_id, film_id) NOT IN (SELECT (user_id, film_id) FROM split WHERE role <> 'context')), l AS (SELECT * FROM hold),
    {sampled_sql(100)}, g AS (SELECT *, max(label) OVER (PARTITION BY user_id) AS best FROM sampled) SELECT user_id, film_id, label, taken_by, {_RANKS} FROM g JOIN t_ranked r USING (user_id, film_id) WHERE best > 0"""))
def ranking_dataset_train(spark, sf_dir):
    examples = _examples(spark, sf_dir, "train")
    context = saved(examples.where("kind = 'context'").select("user_id", "film_id", "rating"))
    return training.partition_dataset(_fused(candidates_of_context(spark, sf_dir, context), context, derived(spark, sf_dir, "item_vectors")), examples, 100)


def _fused(candidates: DataFrame, context: DataFrame, items: DataFrame) -> DataFrame:
    """Fused candidates that occur in the context: all popular ones do, so that only model films are looked up."""
    known = ranking.small(saved(items.select("film_id").distinct().join(context.select("film_id"), "film_id", "left_semi").withColumn("__known", F.lit(True))))
    return candidates.join(known, "film_id", "left").where("popularity_rank IS NOT NULL OR __known").drop("__known")


def _test_dataset(spark, sf_dir) -> DataFrame:
    examples = _examples(spark, sf_dir, "test")
    context = saved(examples.where("kind = 'context'").select("user_id", "film_id", "rating"))
    return training.partition_dataset(_fused(candidates_of_context(spark, sf_dir, context), context, derived(spark, sf_dir, "item_vectors")), examples)


_TEST = f"""WITH l AS (SELECT user_id, film_id, {_LABEL} AS label FROM split WHERE role = 'test'), ds AS (SELECT r.user_id, r.film_id, coalesce(label, 0) AS label, 'all' AS taken_by, {_RANKS} FROM c_ranked r LEFT JOIN l USING (user_id, film_id)
    WHERE r.user_id IN (SELECT user_id FROM l) AND (r.user_id, r.film_id) NOT IN (SELECT (user_id, film_id) FROM split WHERE role = 'validation'))"""


@query("ranking_dataset_test", sql(f"{_TEST} SELECT * FROM ds"))
def ranking_dataset_test(spark, sf_dir):
    return _test_dataset(spark, sf_dir)


@query("ranking_dataset_summary", sql(f"{_TEST}, g AS (SELECT user_id, count(*) AS n, count(*) FILTER (label > 0) AS p FROM ds GROUP BY user_id) SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows_, CAST(sum(p) AS BIGINT) AS positives, count(*) FILTER (p = 0) AS without_positive, max(n) AS largest FROM g"))
def ranking_dataset_summary(spark, sf_dir):
    return training.dataset_summary(_test_dataset(spark, sf_dir))


_IN = "film_id IN (SELECT film_id FROM film_entity WHERE family = '{}' AND lower(name) IN {})"
_LIKED = "SELECT '{0}', t.user_id, t.film_id FROM t JOIN (SELECT DISTINCT user_id, film_id FROM c_good JOIN film_entity USING (family, entity_id) WHERE family = '{1}' AND place <= {2}) USING (user_id, film_id)"


@query("semantic_recall", sql(f"""WITH t AS (SELECT s.user_id, s.film_id, stratum, round(list_inner_product(uvec, vec::DOUBLE[]), 6) AS score, indexed_positive, year FROM (SELECT user_id, film_id FROM split WHERE role = 'test') s JOIN films USING (film_id) LEFT JOIN c_strata USING (film_id) LEFT JOIN c_uservec USING (user_id) LEFT JOIN item_vectors USING (film_id) LEFT JOIN c_prof USING (user_id)),
    e AS (SELECT 'top_picks' AS key, user_id, film_id FROM t UNION ALL SELECT 'hidden_gems', user_id, film_id FROM t WHERE stratum IN ('MID', 'TAIL') AND indexed_positive >= 3 AND score > 0 UNION ALL SELECT 'classic_cinema', user_id, film_id FROM t WHERE year <= 1969 AND score > 0
    UNION ALL SELECT 'national_cinema', user_id, film_id FROM t WHERE score > 0 AND {_IN.format('country', "('nation_1', 'nation_7')")} AND {_IN.format('language', "('america', 'europe')")} UNION ALL {_LIKED.format('favorite_genre', 'genre', 1)} UNION ALL {_LIKED.format('favorite_decade', 'decade', 1)} UNION ALL {_LIKED.format('directors_you_love', 'director', 15)}),
    r AS (SELECT e.key, pos AS rank, k.film_id IS NOT NULL AS got FROM e LEFT JOIN c_shelved x ON x.key = e.key AND x.user_id = e.user_id AND x.film_id = e.film_id LEFT JOIN c_ranked k ON k.user_id = e.user_id AND k.film_id = e.film_id)
    SELECT key, {_M}, count(*) FILTER (got) AS retrieved, count(rank) AS recommended, round(count(*) FILTER (got) / count(*)::DOUBLE, 6) AS candidate_recall, round(count(rank) / count(*)::DOUBLE, 6) AS category_recall FROM r GROUP BY key"""))
def semantic_recall(spark, sf_dir):
    """How often a held-out target that belongs to a shelf's subject is among the candidates and on the shelf, from the context alone."""
    rows, films, entity, items = split(spark, sf_dir), derived(spark, sf_dir, "films"), derived(spark, sf_dir, "film_entity"), derived(spark, sf_dir, "item_vectors")
    context = rows.where("role = 'context'").select("user_id", "film_id", "rating")
    p = parts(spark, sf_dir, context)
    targets = X.target_scores(vectors.user_profiles(context, items), rows.where("role = 'test'"), items).join(films.select("film_id", "year"), "film_id")
    targets = targets.join(ranking.with_strata(ranking.popularity(context)).select("film_id", "stratum"), "film_id", "left").join(p["users"].select("user_id", "indexed_positive"), "user_id", "left")
    for family, names in (("country", POLICY.national_countries), ("language", POLICY.national_languages)):
        named = entity.where((F.col("family") == family) & F.lower("name").isin(*names)).select("film_id", F.lit(True).alias(family)).distinct()
        targets = targets.join(named, "film_id", "left")
    good = p["good"]
    for family, places in (("genre", 1), ("decade", 1), ("director", POLICY.director_pool)):
        loved = good.where((F.col("family") == family) & (F.col("place") <= places)).select("user_id", "family", "entity_id").join(entity, ["family", "entity_id"]).select("user_id", "film_id", F.lit(True).alias(family)).distinct()
        targets = targets.join(loved, ["user_id", "film_id"], "left")
    near = F.col("score") > 0
    scopes = {
        "top_picks": F.lit(True), "hidden_gems": F.col("stratum").isin("MID", "TAIL") & (F.col("indexed_positive") >= POLICY.hidden_positives) & near, "classic_cinema": (F.col("year") <= POLICY.classic_year) & near,
        "national_cinema": F.col("country") & F.col("language") & near, "favorite_genre": F.col("genre"), "favorite_decade": F.col("decade"), "directors_you_love": F.col("director"),
    }
    targets = saved(targets)
    # Only the targets among candidates and shelves are looked for, and all shelves in one pass.
    wanted = targets.select("user_id", "film_id")
    svd, reach = p["sources"]
    found = ranking.candidates(svd, reach, DEPTH, wanted).join(p["strata"], "film_id", "left_semi")
    key = F.when(F.col("key") == NAMED["national_cinema"], "national_cinema").otherwise(F.col("key"))
    held = wanted.groupBy("user_id").agg(F.collect_set("film_id").alias("held"))
    shelved = proposed(p, {NAMED.get(k, k) for k in scopes}).join(held, "user_id").where(F.array_contains("held", F.col("film_id")))
    return X.semantic_recall(targets, scopes, found, shelved.select(key.alias("key"), "user_id", "film_id", F.col("pos").cast("bigint").alias("rank")))


#: Policies to compare, each with the shelf that it changes and that shelf's SQL.
_VARIANTS = {
    "default": ("hidden_gems", {}, SHELF_SQL["hidden_gems"]),
    "hidden_wide": ("hidden_gems", {"hidden_mid_rank": 180, "hidden_tail_rank": 150}, SHELF_SQL["hidden_gems"].replace("svd_rank <= 150", "svd_rank <= 180").replace("svd_rank <= 100", "svd_rank <= 150")),
    "hidden_long": ("hidden_gems", {"hidden_minimum": 20}, SHELF_SQL["hidden_gems"].replace("n >= 6", "n >= 20")),
    "directors_few": ("directors_you_love", {"director_pool": 3}, SHELF_SQL["directors_you_love"].replace("place <= 15", "place <= 3")),
    "genre_long": ("favorite_genre", {"genre_minimum": 30}, SHELF_SQL["favorite_genre"].replace("n >= 6", "n >= 30")),
}


@query("policy_variants", sql("WITH v AS (" + " UNION ALL ".join(f"SELECT '{name}' AS variant, '{key}' AS key, user_id, film_id FROM ({text})" for name, (key, _, text) in _VARIANTS.items()) + ") SELECT variant, key, count(DISTINCT user_id) AS users, count(*) AS slots, count(DISTINCT film_id) AS films, round(avg(CASE WHEN stratum = 'HEAD' THEN 1.0::DOUBLE ELSE 0 END), 6) AS head_share FROM v JOIN strata USING (film_id) GROUP BY variant, key"))
def policy_variants(spark, sf_dir):
    p = parts(spark, sf_dir)
    rows = [shelf_of(key, p, dataclasses.replace(POLICY, **change)).select(F.lit(name).alias("variant"), F.lit(key).alias("key"), "user_id", "film_id", "head") for name, (key, change, _) in _VARIANTS.items()]
    return X.variant_report(functools.reduce(DataFrame.unionByName, rows))


@query("director_reasons", sql(f"WITH s AS ({SHELF_SQL['directors_you_love']}) SELECT s.user_id, s.film_id, 'DIRECTOR_AFFINITY' AS code, CASE WHEN membership = 'both' THEN 'SOURCE_AGREEMENT' ELSE '' END AS additional_codes, stratum, membership = 'both' AS retrieved_by_both, family, name, support, high, tier FROM s JOIN ranked USING (user_id, film_id) JOIN film_entity e USING (film_id) JOIN (SELECT user_id, family, entity_id, support, high, tier FROM good WHERE place <= 15) USING (user_id, family, entity_id) WHERE family = 'director'"))
def director_reasons(spark, sf_dir):
    """Why each film of the directors' shelf is there; a film of several loved directors has a row for each."""
    p = parts(spark, sf_dir)
    good = preferences.qualified(p["preferences"], POLICY).where((F.col("family") == "director") & (F.col("place") <= POLICY.director_pool)).select("user_id", "family", "entity_id", "support", "high")
    rows = shelf_of("directors_you_love", p).select("user_id", "film_id").join(p["ranked"].select("user_id", "film_id", "membership", "stratum"), ["user_id", "film_id"])
    rows = rows.join(p["film_entity"].select("film_id", "family", "entity_id", "name"), "film_id").join(good, ["user_id", "family", "entity_id"])
    reason = reasons.entity("DIRECTOR_AFFINITY", POLICY.director_support)
    return rows.select("user_id", "film_id", reason.alias("r")).select("user_id", "film_id", "r.*").withColumn("additional_codes", F.array_join("additional_codes", ","))


@query("displayed_candidates", sql("SELECT user_id, film_id, title, director, round(rrf_score, 4) AS score, rrf_rank FROM ranked JOIN films USING (film_id) LEFT JOIN (SELECT film_id, min(name) AS director FROM film_entity WHERE family = 'director' GROUP BY film_id) USING (film_id) WHERE rrf_rank <= 10"))
def displayed_candidates(spark, sf_dir):
    directors = derived(spark, sf_dir, "film_entity").where("family = 'director'").groupBy("film_id").agg(F.array_sort(F.collect_set("name")).alias("directors"))
    rows = inventory(spark, sf_dir).where("rrf_rank <= 10").join(derived(spark, sf_dir, "films").select("film_id", "title"), "film_id").join(directors, "film_id", "left")
    return rows.select("user_id", "film_id", "title", reasons.first_name(F.col("directors")).alias("director"), reasons.shown_score(F.col("rrf_score")).alias("score"), "rrf_rank")

