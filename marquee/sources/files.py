"""File readers with cleaning and strict loads, and the writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.functions import cleaning as C
from marquee.functions.ratings import bucket
from marquee.operators.quality import DataError, conflict_checked, first_by, gate
from marquee.operators.vectors import vector_audit

LISTS = ("directors", "actors", "genres", "countries", "languages", "studios", "themes")
SCALARS = {"title": C.safe_string, "original_title": C.safe_string, "synopsis": C.safe_string, "tagline": C.safe_string, "slug": C.safe_string, "tmdb_id": C.safe_int, "year": C.parse_year, "runtime": C.safe_int, "total_logs": C.safe_int, "avg_rating": C.safe_double}


def catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """A semicolon-separated film catalog, cleaned; columns that the file lacks are left out. A missing original title is the title."""
    raw = spark.read.csv(path, sep=";", header=True, quote='"', escape='"', multiLine=True)
    out = raw.select(*(f(F.col(c).cast("string")).alias(c) for c, f in SCALARS.items() if c in raw.columns), *(C.parse_list(F.col(c)).alias(c) for c in LISTS if c in raw.columns))
    if {"title", "original_title"} <= set(out.columns):
        out = out.withColumn("original_title", F.coalesce("original_title", "title"))
    return out


def logs_csv(spark: SparkSession, path: str, slugs: DataFrame) -> DataFrame:
    """user_id, username, film_id, rating of user_id;username;slug;rating rows that have a name, a known film and a valid rating."""
    raw = spark.read.csv(path, sep=";", header=True)
    rows = raw.select(C.safe_int(F.col("user_id")).alias("user_id"), C.safe_string(F.col("username")).alias("username"), C.safe_string(F.col("slug")).alias("slug"), C.parse_rating(F.col("rating")).alias("rating"))
    return rows.where("username IS NOT NULL AND rating IS NOT NULL").join(slugs.select("slug", "film_id"), "slug").drop("slug")


def slug_mapping(films: DataFrame) -> DataFrame:
    """slug, film_id; fails unless both are unique and ids are positive."""
    rows = films.select("slug", "film_id")
    bad = rows.agg(F.count("*").alias("n"), F.count_distinct("slug").alias("s"), F.count_distinct("film_id").alias("f"), F.count_if(F.col("film_id") <= 0).alias("low"))
    gate(bad.where("n <> s OR n <> f OR low > 0"), "slugs and film ids must pair one to one, ids positive")
    return rows


def cohort_csv(spark: SparkSession, path: str, slugs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(logs, summary) of a controlled cohort: any bad user, rating or conflict fails the load; unknown films are counted and dropped."""
    raw = spark.read.csv(path, sep=";", header=True).select("user_id", "slug", "rating")
    user, rating = F.trim("user_id").try_cast("bigint"), F.trim("rating").try_cast("double")
    gate(raw.where(user.isNull() | (user < 0) | bucket(rating).isNull()), "a cohort row has a bad user or rating")
    rows = raw.select(user.alias("user_id"), F.trim("slug").alias("slug"), rating.alias("rating")).join(slugs, "slug", "left")
    logs = conflict_checked(rows.where("film_id IS NOT NULL"), ["user_id", "film_id"], "rating")
    if logs.isEmpty():
        raise DataError("a cohort needs a resolved row")
    counts = rows.agg(F.count("*").alias("csv_rows"), F.count("film_id").alias("resolved"), F.count_if(F.col("film_id").isNull()).alias("unresolved"))
    unique = logs.agg(F.sum("duplicates").alias("duplicates"), F.count_distinct("user_id").alias("users"), F.count_distinct("film_id").alias("films"))
    return logs.drop("duplicates"), counts.crossJoin(unique)  # one row each


def export_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """username, uri, name, year, rating of folders <username>/watched.csv and ratings.csv; rated films that weren't watched are ignored."""

    def read(name: str) -> DataFrame:
        rows = spark.read.csv(f"{folder}/*/{name}", header=True, mode="FAILFAST", enforceSchema=False)
        rows = rows.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("username"))
        names = [c.lower().lstrip("\ufeff") for c in rows.columns]
        return rows.toDF(*("uri" if c.endswith("uri") else c for c in names)).where("uri IS NOT NULL")

    watched = first_by(read("watched.csv"), ["username", "uri"], ["date", "name"])
    rated = first_by(read("ratings.csv"), ["username", "uri"], ["date", "name"]).select("username", "uri", C.parse_rating(F.col("rating")).alias("rating"))
    return watched.select("username", "uri", "name", C.parse_year(F.col("year")).alias("year")).join(rated, ["username", "uri"], "left")


def write_popularity(popular: DataFrame, path: str) -> None:
    popular.select("film_id", "positives", "popularity_rank").write.mode("errorifexists").parquet(path)


def read_popularity(spark: SparkSession, path: str) -> DataFrame:
    """A stored popularity table; fails unless ids are unique, counts not negative and ranks 1 to n in order."""
    rows = spark.read.parquet(path)
    order = Window.partitionBy(F.floor(F.col("popularity_rank") / 100_000)).orderBy("popularity_rank")
    before = F.lag("positives").over(order)
    bad = rows.withColumn("b", before).agg(F.count("*").alias("n"), F.count_distinct("film_id").alias("f"), F.count_distinct("popularity_rank").alias("r"), F.min("popularity_rank").alias("lo"), F.max("popularity_rank").alias("hi"), F.count_if((F.col("positives") < 0) | (F.col("positives") > F.col("b"))).alias("off"))
    gate(bad.where("n = 0 OR n <> f OR n <> r OR lo <> 1 OR hi <> n OR off > 0"), "a popularity table is broken")
    return rows


def append_interactions(rows: DataFrame, path: str) -> None:
    """Appends resolved rows in one job, whose files appear together or not at all; a row without a user or film, or a pair given twice, fails it before."""
    gate(rows.where("user_id IS NULL OR film_id IS NULL"), "an interaction has no user or film")
    gate(rows.groupBy("user_id", "film_id").count().where("count > 1"), "an interaction is given twice")
    rows.select("user_id", "film_id", "rating").write.mode("append").parquet(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("film_id", "vec").write.mode("errorifexists").parquet(path)


def read_vectors(spark: SparkSession, path: str, tolerance: float = 1e-4) -> DataFrame:
    """Stored item vectors; fails unless there are any, ids are unique, all have one length and every one is finite and of unit norm."""
    rows = spark.read.parquet(path)
    bad = vector_audit(rows, tolerance).where("rows_ = 0 OR rows_ <> ids OR dimensions <> 1 OR bad_values > 0 OR bad_norms > 0")
    gate(bad, "a vector table is broken")
    return rows


def write_partitions(rows: DataFrame, path: str) -> None:
    """A ranking dataset by seed, fold and partition."""
    rows.write.mode("overwrite").partitionBy("seed", "fold", "partition").parquet(path)


def read_partition(spark: SparkSession, path: str, seed: int, fold: int, partition: str) -> DataFrame:
    return spark.read.parquet(path).where((F.col("seed") == seed) & (F.col("fold") == fold) & (F.col("partition") == partition))


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
