"""Identity resolution and reconciliation of incoming rows with what is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.cleaning import parse_rating, safe_string, title_key
from marquee.functions.reasons import missing_history
from marquee.operators.quality import first_by, ranged


def resolve(rows: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """rows with the mapping's columns; unresolved ones keep nulls."""
    return rows.join(mapping, key, "left")


def resolution_counts(resolved: DataFrame, column: str) -> DataFrame:
    return resolved.agg(F.count("*").alias("rows_"), F.count(column).alias("resolved"), F.count_if(F.col(column).isNull()).alias("unresolved"))


def new_identities(names: DataFrame, known: DataFrame, name: str = "name", id_: str = "id") -> DataFrame:
    """name and id of names that aren't known, numbered after the greatest known id in order of name."""
    top = known.agg(F.coalesce(F.max(id_), F.lit(0)).alias("__top"))
    fresh = names.select(name).where(F.col(name).isNotNull()).distinct().join(known.select(name), name, "left_anti")
    out = ranged(fresh, [name], "__i").crossJoin(F.broadcast(top))
    return out.select(name, (F.col("__top") + F.col("__i")).cast("bigint").alias(id_))


def exploded_relation(films: DataFrame, list_column: str, entities: DataFrame) -> DataFrame:
    """film_id, entity_id of a list of names, each once."""
    names = films.select("film_id", F.explode(F.array_distinct(list_column)).alias("name"))
    return names.join(entities.select("name", F.col("id").alias("entity_id")), "name").select("film_id", "entity_id").distinct()


def resolve_titles(entries: DataFrame, films: DataFrame) -> DataFrame:
    """entry_id, film_id, outcome (resolved, ambiguous, not_found): by display title and year, by original title only if no display title fits."""
    e = entries.select("entry_id", title_key(F.col("title")).alias("key"), "year")

    def hits(column: str, out: str) -> DataFrame:
        f = films.select(title_key(F.col(column)).alias("key2"), F.col("year").alias("year2"), "film_id")
        joined = e.join(f, (F.col("key") == F.col("key2")) & F.col("year").eqNullSafe(F.col("year2")))
        return joined.groupBy("entry_id").agg(F.min("film_id").alias(out), F.count_distinct("film_id").alias(f"{out}_n"))

    both = e.select("entry_id").join(hits("title", "a"), "entry_id", "left").join(hits("original_title", "b"), "entry_id", "left")
    n = F.coalesce("a_n", "b_n", F.lit(0))
    return both.select("entry_id", F.when(n == 1, F.coalesce("a", "b")).alias("film_id"), F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("not_found").alias("outcome"))


def watched_with_ratings(watched: DataFrame, ratings: DataFrame) -> DataFrame:
    """Every watched row with its rating if any; ratings of films that weren't watched are ignored."""
    return watched.join(ratings, [c for c in watched.columns if c in ratings.columns], "left")


def valid_watches(rows: DataFrame) -> DataFrame:
    """rows(username, slug, rating text, ...) with a slug; a rating that isn't valid makes the film unrated."""
    out = rows.withColumn("slug", safe_string(F.col("slug"))).where("slug IS NOT NULL")
    return out.withColumn("rating", parse_rating(F.col("rating")))


def histories(users: DataFrame, logs: DataFrame, items: DataFrame) -> DataFrame:
    """user_id, watched, rated, usable (rated films of the model), info of every user of users(user_id); info tells why nothing can be recommended."""
    known = logs.join(items.select("film_id", F.lit(True).alias("__in")), "film_id", "left")
    counts = known.groupBy("user_id").agg(F.count("*").alias("watched"), F.count("rating").alias("rated"), F.count_if(F.col("__in") & F.col("rating").isNotNull()).alias("usable"))
    rows = users.join(counts, "user_id", "left").na.fill(0, ["watched", "rated", "usable"])
    return rows.select("user_id", "watched", "rated", "usable", missing_history(F.col("watched"), F.col("usable")).alias("info"))


def in_catalog(rows: DataFrame, films: DataFrame, key: str = "film_id") -> DataFrame:
    """The rows whose film is in the catalog."""
    return rows.join(films.select(key), key, "left_semi")


def of_years(films: DataFrame, years: DataFrame, unknown: bool = True) -> DataFrame:
    """Films of years(year), and those of no known year."""
    hits = films.join(years.select("year").where("year IS NOT NULL"), "year", "left_semi").select(films.columns)
    return hits.unionByName(films.where("year IS NULL")) if unknown else hits


def first_seen(rows: DataFrame, keys: list[str], identity: list[str], order: str) -> DataFrame:
    """keys, the identity of each key's first row by order, and whether its rows disagree on it."""
    whole = F.struct(*identity)
    out = rows.groupBy(*keys).agg(F.min_by(whole, order).alias("__i"), (F.count_distinct(whole) > 1).alias("conflict"))
    return out.select(*keys, *(F.col("__i")[c].alias(c) for c in identity), "conflict")


def promote_pending(pending: DataFrame, users: DataFrame, logs: DataFrame, processed: DataFrame) -> DataFrame:
    """id, user_id, film_id, rating, action of pending(id, username, slug, rating) whose film has been processed(slug, film_id).

    failed without a user; retired where a log exists or an earlier pending row makes it; else insert.
    """
    rows = pending.join(processed, "slug").join(users.select("username", "user_id"), "username", "left")
    rows = rows.join(logs.select("user_id", "film_id", F.lit(True).alias("has")), ["user_id", "film_id"], "left")
    first = F.row_number().over(Window.partitionBy("user_id", "film_id").orderBy("id"))
    action = F.when(F.col("user_id").isNull(), "failed").when(F.col("has") | (F.col("__rn") > 1), "retired").otherwise("insert")
    return rows.withColumn("__rn", first).select("id", "user_id", "film_id", "rating", action.alias("action"))


def reconcile(profile: DataFrame, films: DataFrame, logs: DataFrame, queue: DataFrame, pending: DataFrame) -> DataFrame:
    """username, slug, rating, action of a profile(username, user_id, slug, rating, seq): the last row of a film counts.

    Known films: insert, update (a new rating) or keep. Unknown: wait (queued already, open), enqueue (not queued),
    terminal (queued and filtered or failed), or refresh where it is pending with another rating.

    A user's profile and logs are shuffled together by user and slug, where a log stands in front of the profile's last row. Films
    and queue are one table, so that the profile meets them in one join; logs (a row a user and film), films and queue are unique.
    """
    types, key = dict(profile.dtypes), ["user_id", "slug"]
    marks = logs.join(films.select("slug", "film_id"), "film_id").where("user_id IS NOT NULL AND slug IS NOT NULL")
    marks = marks.select(*(F.col(c).cast(types[c]).alias(c) for c in key), F.col("rating").alias("old"), F.lit(True).alias("mark"))
    rows = profile.select(*key, "username", "rating", "seq", F.lit(False).alias("mark")).unionByName(marks, allowMissingColumns=True)
    turn = Window.partitionBy(*key).orderBy(F.col("mark").desc(), F.col("seq").desc())
    rows = rows.withColumns({"logged": F.lag("mark").over(turn), "old": F.lag("old").over(turn)}).where(~F.col("mark") & F.coalesce("logged", F.lit(True)))
    known = F.when(F.col("logged").isNull(), "insert").when(~F.col("old").eqNullSafe(F.col("rating")), "update").otherwise("keep")
    catalog = films.select("slug", "film_id").join(queue.select("slug", "status"), "slug", "full")
    rows = rows.select(*key, "username", "rating", known.alias("action")).join(catalog, "slug", "left")
    # What is left open hangs on the pending row.
    status = F.col("status")
    action = F.when(F.col("film_id").isNotNull(), F.col("action")).when(status.isNull(), "enqueue").when(status.isin("FILTERED", "FAILED"), "terminal")
    rows = rows.select("username", "user_id", "slug", "film_id", "rating", action.alias("action"))
    rows = rows.join(pending.select("username", "slug", F.col("rating").alias("waiting"), F.lit(True).alias("is_pending")), ["username", "slug"], "left")
    waits = F.when(F.col("is_pending") & ~F.col("waiting").eqNullSafe(F.col("rating")), "refresh").otherwise("wait")
    return rows.select("username", "user_id", "slug", "film_id", "rating", F.coalesce("action", waits).alias("action"))


def propagate_terminal(pending: DataFrame, queue: DataFrame) -> DataFrame:
    """pending with the status of a queue entry that ended FILTERED or FAILED."""
    ended = queue.where(F.col("status").isin("FILTERED", "FAILED")).select("slug", F.col("status").alias("__end"))
    rows = pending.join(ended, "slug", "left")
    return rows.withColumn("status", F.when((F.col("status") == "PENDING") & F.col("__end").isNotNull(), F.col("__end")).otherwise(F.col("status"))).drop("__end")


def apply_results(batch: DataFrame, results: DataFrame) -> DataFrame:
    """batch(slug, attempts) with outcome, error and attempts after a scrape; no result is a failure."""
    rows = batch.join(results.select("slug", "outcome", "error"), "slug", "left")
    return rows.select("slug", F.coalesce("outcome", F.lit("FAILED")).alias("outcome"), F.when(F.col("outcome").isNull(), "Scraper returned no result").otherwise(F.col("error")).alias("error"), (F.col("attempts") + 1).alias("attempts"))


def refreshed(films: DataFrame, results: DataFrame, years: Column) -> DataFrame:
    """films with avg_rating and total_logs from results in the given years; a missing field leaves the old value."""
    new = results.select("film_id", F.col("avg_rating").alias("__a"), F.col("total_logs").alias("__t"))
    due = F.array_contains(years, F.col("year"))
    return films.join(new, "film_id", "left").withColumns({"avg_rating": F.when(due, F.coalesce("__a", "avg_rating")).otherwise(F.col("avg_rating")), "total_logs": F.when(due, F.coalesce("__t", "total_logs")).otherwise(F.col("total_logs"))}).drop("__a", "__t")


def donors(users: DataFrame, shift: int) -> DataFrame:
    """user_id and donor_id: the user shift places on in order of id, cyclically."""
    from marquee.operators.quality import numbered

    at = numbered(users.select("user_id").distinct(), "user_id", "i")
    n = at.agg(F.count("*").alias("n"))
    to = at.select(F.col("user_id").alias("donor_id"), F.col("i").alias("j"))
    rows = at.crossJoin(F.broadcast(n)).withColumn("j", F.pmod(F.col("i") - 1 + shift, F.col("n")) + 1)
    return rows.join(to, "j").select("user_id", "donor_id")


def upserted(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """table after changes(keys, ..., order): the last change of a key wins over the stored row."""
    rows = table.withColumn(order, F.lit(None).cast(dict(changes.dtypes)[order])).unionByName(changes.select(*table.columns, order))
    return first_by(rows, keys, [F.col(order).desc_nulls_last()]).drop(order)
