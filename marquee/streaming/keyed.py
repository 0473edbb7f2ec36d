"""A table by key in hashed buckets, of which a batch rewrites only those that its keys fall into."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marquee.sources.work import remove, versions

BUCKET = "__bucket"
#: Rows that a task of a merge holds, about.
PART = 1 << 20


class KeyedTable:
    """Rows of a schema under path, one bucket a hash of keys.

    ``data/<batch>/__bucket=<b>`` holds what a batch wrote, ``manifest/<batch>`` tells for every bucket which batch wrote it last. A
    manifest appears when its batch is whole, so that a reader sees a batch altogether or not at all; a batch that comes again
    starts from the manifest before it and replaces its own files. The last two manifests stay readable.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType, buckets: int = 32, part_rows: int = PART):
        self.spark, self.path, self.keys, self.schema, self.buckets, self.part_rows = spark, path, keys, schema, buckets, part_rows

    def bucket(self):
        """The bucket of a row."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def batches(self) -> list[int]:
        return versions(self.spark, f"{self.path}/manifest")

    def manifest(self, batch: int | None) -> dict[int, int]:
        """Batch of each bucket that has rows; at most ``buckets`` entries."""
        if batch is None:
            return {}
        return {r.bucket: r.batch for r in self.spark.read.parquet(f"{self.path}/manifest/{batch}").collect()}

    def _files(self, entries: dict[int, int]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{batch}/{BUCKET}={b}" for b, batch in sorted(entries.items())))

    def read(self) -> DataFrame:
        """All rows as of the last whole batch."""
        done = self.batches()
        return self._files(self.manifest(done[-1] if done else None))

    def written(self, batch: int) -> DataFrame:
        """The buckets that a batch wrote, whole."""
        return self._files({b: n for b, n in self.manifest(batch).items() if n == batch})

    def merge(self, rows: DataFrame, batch: int, fold: Callable[[DataFrame], DataFrame]) -> None:
        """Writes fold(kept rows and new rows) of the buckets that rows fall into; fold gives one row a key, in the table's columns."""
        before = [n for n in self.batches() if n < batch]
        known = self.manifest(before[-1] if before else None)
        rows = rows.select(*self.schema.names)
        new = dict(rows.groupBy(self.bucket().alias("b")).count().collect())  # at most as many as there are buckets
        touched = list(new)
        kept = self._files({b: known[b] for b in touched if b in known})
        if touched:
            # One shuffle: rows of a key are in one part of a bucket, so that the fold needs no other. Large buckets have more parts.
            parts = -(-(kept.count() + sum(new.values())) // (len(touched) * self.part_rows))
            part = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets * parts))
            both = kept.unionByName(rows).withColumn(BUCKET, part)
            folded = fold(both.repartition(min(len(touched), self.buckets) * parts, BUCKET)).select(*self.schema.names).withColumn(BUCKET, self.bucket())
            folded.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/data/{batch}")
        entries = sorted((known | dict.fromkeys(touched, batch)).items())
        self.spark.createDataFrame(entries, "bucket int, batch bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{batch}")
        if len(before) > 1:
            stay = {*known.items(), *entries}
            for b, n in self.manifest(before[-2]).items():
                if (b, n) not in stay:
                    remove(self.spark, f"{self.path}/data/{n}/{BUCKET}={b}")
            remove(self.spark, f"{self.path}/manifest/{before[-2]}")


def last_by(keys: list[str], value: list[str], order: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A fold that keeps the values and order of each key's last row by order; ties of order go to the greater values."""

    def fold(both: DataFrame) -> DataFrame:
        last = F.max(F.struct(*order, *value)).alias("last")
        return both.groupBy(BUCKET, *keys).agg(last).select(*keys, *(F.col(f"last.{c}").alias(c) for c in (*value, *order)))

    return fold
