"""Versions of the model that is served: decide, build beside the current version, validate, promote, retain."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators import ranking, vectors
from marquee.operators.evaluation import retraining_decision
from marquee.sources import files, gated
from marquee.sources.work import remove, versions

_MANIFEST = "trained_at timestamp, users bigint, interactions bigint, films bigint"
Build = Callable[[DataFrame, str], None]


def svd_and_popularity(rank: int = 32) -> Build:
    """A build of item vectors and popularity from one snapshot of rated interactions."""

    def build(rated: DataFrame, path: str) -> None:
        files.write_vectors(vectors.truncated_svd(rated, rank), f"{path}/item_vectors")
        files.write_popularity(ranking.popularity(rated), f"{path}/popularity")

    return build


class ModelStore:
    """Versions under ``models/<number>`` of a path; ``current/<number>`` has the manifest of a promoted one, the last is served.

    A manifest under current appears whole or not at all, after its version was written and read back, so a reader sees the old
    version or the new one. What a stopped build left isn't seen and goes with the next build. One job at a time may build.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def promoted(self) -> list[int]:
        return versions(self.spark, f"{self.path}/current")

    def manifest(self, number: int) -> dict:
        return self.spark.read.parquet(f"{self.path}/current/{number}").first().asDict()

    def vectors(self, number: int) -> DataFrame:
        return files.read_vectors(self.spark, f"{self.path}/models/{number}/item_vectors")

    def popularity(self, number: int) -> DataFrame:
        return files.read_popularity(self.spark, f"{self.path}/models/{number}/popularity")

    def decision(self, logs: DataFrame, now: datetime, forced: bool = False, users: int = 100, films: int = 250, days: int = 180) -> dict:
        """user_delta, interaction_delta, new_films, age_days and reasons of logs against the served version (or none)."""
        done = self.promoted()
        trained, known = self.spark.createDataFrame([], "users bigint, interactions bigint, age_days double"), self.spark.createDataFrame([], "film_id bigint")
        if done:
            m = self.manifest(done[-1])
            age = max(0.0, (now - m["trained_at"]).total_seconds() / 86400)
            trained = self.spark.createDataFrame([(m["users"], m["interactions"], age)], trained.schema)
            known = self.spark.read.parquet(f"{self.path}/models/{done[-1]}/popularity").select("film_id")
        return retraining_decision(logs, known, trained, forced, users, films, days).first().asDict()

    def validate(self, number: int, counts: dict) -> None:
        """Fails unless both tables of a version pass their own gates and hold the films of its snapshot, as many as counted."""
        base = f"{self.path}/models/{number}"
        rated = self.spark.read.parquet(f"{base}/rated").select("film_id").distinct()
        for name, rows in (("vector", self.vectors(number)), ("popularity", self.popularity(number))):
            both = rated.select("film_id", F.lit(1).alias("a")).join(rows.select("film_id", F.lit(1).alias("b")), "film_id", "full")
            got = both.agg(F.count("b").alias("n"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("off"))
            files.gate(got.where((F.col("off") > 0) | (F.col("n") != counts["films"])), f"films of the snapshot and of the {name} table differ")

    def retrain(self, logs: DataFrame, now: datetime, forced: bool = False, build: Build | None = None, keep: int = 1, **limits: int) -> dict:
        """Decides on logs(user_id, film_id, rating), and where a retraining is due, builds, validates and promotes a version.

        Returns the decision with outcome ('not due', 'not due on the snapshot' or 'promoted') and version, the one that is served
        now (null: none). The decision is first made on the logs as they are, then again on the snapshot that was written of them,
        which all parts of the version are built from, as logs may change between. Whatever fails takes the new version with it and
        leaves the served one. keep: how many versions stay beside it.
        """
        done = self.promoted()
        served = done[-1] if done else None
        first = self.decision(logs, now, forced, **limits)
        if not first["reasons"]:
            return first | {"outcome": "not due", "version": served}
        number = (served or 0) + 1
        base = f"{self.path}/models/{number}"
        remove(self.spark, base)  # of a build that was stopped: no promoted version has this number
        try:
            gated.write_rated(logs, f"{base}/rated")
            rated = self.spark.read.parquet(f"{base}/rated")
            again = self.decision(rated, now, forced, **limits)
            if not again["reasons"]:
                remove(self.spark, base)
                return again | {"outcome": "not due on the snapshot", "version": served}
            counts = rated.agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("interactions"), F.count_distinct("film_id").alias("films")).first().asDict()
            (build or svd_and_popularity())(rated, base)
            self.validate(number, counts)
        except Exception:
            remove(self.spark, base)
            raise
        row = (now, counts["users"], counts["interactions"], counts["films"])
        self.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/current/{number}")
        for old in done[: max(0, len(done) - keep)]:
            remove(self.spark, f"{self.path}/current/{old}")  # first, so that no manifest is left without its tables
            remove(self.spark, f"{self.path}/models/{old}")
        return again | {"outcome": "promoted", "version": number}
