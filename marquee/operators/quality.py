"""Deduplication and validation gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.sources.work import saved


class DataError(ValueError):
    """Rows break a rule of a strict load."""


def gate(bad: DataFrame, what: str) -> None:
    """Raises if bad has a row."""
    if not bad.isEmpty():
        raise DataError(what)


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", place).where("__rn = 1").drop("__rn")


def conflict_checked(df: DataFrame, keys: list[str], value: str, strict: bool = True) -> DataFrame:
    """keys, value and duplicates of equal rows; rows that disagree on value fail (or carry conflict if not strict)."""
    out = df.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("__hi"), F.count("*").alias("n"))
    out = out.select(*keys, value, (F.col("n") - 1).alias("duplicates"), (~F.col(value).eqNullSafe(F.col("__hi"))).alias("conflict"))
    if strict:
        gate(out.where("conflict"), f"rows with the same {keys} disagree on {value}")
        out = out.drop("conflict")
    return out


def last_write(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The value of the last row by order for each key."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def universe_audit(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys of each side, and of each side alone."""
    a, b = a.select(key).distinct(), b.select(key).distinct()
    return (
        a.agg(F.count("*").alias("left_keys")).crossJoin(b.agg(F.count("*").alias("right_keys")))
        .crossJoin(a.join(b, key, "left_anti").agg(F.count("*").alias("left_only"))).crossJoin(b.join(a, key, "left_anti").agg(F.count("*").alias("right_only")))
    )


def stride(df: DataFrame, order: str, k: int) -> DataFrame:
    """Every k-th row by order, the first included. Rows are numbered range by range."""
    return numbered(df, order, "__number").where(F.pmod(F.col("__number") - 1, F.lit(k)) == 0).drop("__number")


def numbered(df: DataFrame, order: str, out: str = "number") -> DataFrame:
    """Numbers rows 1, 2, ... by a unique column. Ranges are cut by a sample of its values, so that skewed ids don't meet in one."""
    return ranged(df, [order], out)


def ranged(df: DataFrame, order: list[str], out: str = "number") -> DataFrame:
    """Numbers rows 1, 2, ... by order, columns of any type that tell all rows apart.

    Rows are sorted in ranges and written once, so that numbers hold; the counts of the ranges, a short table, give the offsets.
    """
    low = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    rows = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())).withColumn("__p", F.shiftright("__m", 33))
    sizes = rows.groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(sizes), "__p").withColumn(out, (low + 1 + F.col("__before")).cast("bigint")).drop("__p", "__m", "__before")


def oldest(df: DataFrame, status: str, n: int) -> DataFrame:
    """The n oldest rows with a status, by created_at and id."""
    return df.where(F.col("status") == status).orderBy("created_at", "id").limit(n)


def leaked(targets: DataFrame, context: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many targets are in the context; 0 is clean."""
    return targets.join(context.select(*keys), keys, "left_semi").agg(F.count("*").alias("leaked"))


def fingerprint(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and a hash of its rows, whatever their order."""
    rows = F.array_sort(F.collect_list(F.struct(*columns)))
    return df.groupBy(key).agg(F.sha2(F.to_json(rows), 256).alias("hash"))


def fingerprint_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys whose hashes differ or that one side lacks."""
    both = a.select(key, F.col("hash").alias("a")).join(b.select(key, F.col("hash").alias("b")), key, "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select(key, "a", "b")
