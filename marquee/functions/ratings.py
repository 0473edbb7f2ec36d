"""Rating bands, buckets and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed rating bands.
POSITIVE, HIGH, NEGATIVE, NEUTRAL, ANCHOR, ANCHOR_FALLBACK = 3.5, 4.5, 2.5, 3.0, 4.5, 4.0
GAINS = (0, 1, 3, 7)


def bucket(rating: Column) -> Column:
    """Half-star rating 0.5 to 5.0 as 0 to 9; anything else null."""
    twice = rating * 2
    return F.when((F.abs(twice - F.rint(twice)) <= 1e-7) & F.rint(twice).between(1, 10), (F.rint(twice) - 1).cast("int"))


def from_bucket(b: Column) -> Column:
    return (b + 1) / 2


def relevance(rating: Column) -> Column:
    """0 below 3.5, 1 at 3.5, 2 at 4.0, 3 from 4.5; null stays null."""
    return F.when(rating >= 4.5, 3).when(rating >= 4.0, 2).when(rating >= 3.5, 1).when(rating.isNotNull(), 0)


def gain(label: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, GAINS)), label + 1)


def stratum(rank: Column, n: Column) -> Column:
    """HEAD, MID or TAIL by popularity rank among n films; an unknown film counts as rank n."""
    r = F.coalesce(rank, n)
    return F.when(r <= F.ceil(n * 0.10), "HEAD").when(r <= F.ceil(n * 0.50), "MID").otherwise("TAIL")


def membership(svd: Column, popularity: Column) -> Column:
    return F.when(svd & popularity, "both").when(svd, "svd_only").when(popularity, "popularity_only").otherwise("missed")


def depth_band(rated: Column, watched: Column, sparse: int = 5, deep: int = 2000) -> Column:
    return F.when(rated < sparse, "sparse").when(watched >= deep, "deep").otherwise("established")


def evidence_tier(support: Column, minimum: Column | int) -> Column:
    return F.when(support >= 2 * F.lit(minimum), "strong").otherwise("minimum")


def quantile_bucket(x: Column, thresholds: list[Column]) -> Column:
    """How many thresholds are at most x."""
    out = F.lit(0)
    for t in thresholds:
        out = out + (x >= t).cast("int")
    return out
