"""Why a film is shown, and how it is displayed, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions import ratings as R


# What a user without recommendations is told.
NO_WATCHED = "No watched films found for this user. Cannot provide recommendations."
NO_USABLE = "No rated films found in the recommendation model for this user. Cannot provide recommendations."


def missing_history(watched: Column, usable: Column) -> Column:
    """Why a user with so many watched films, and rated films of the model, gets no recommendations; null where there is no such reason."""
    return F.when(watched == 0, NO_WATCHED).when(usable == 0, NO_USABLE)


def _candidate(code: str) -> list[Column]:
    both = F.col("membership") == "both"
    agreed = F.when(both, F.array(F.lit("SOURCE_AGREEMENT"))).otherwise(F.array().cast("array<string>"))
    return [F.lit(code).alias("code"), agreed.alias("additional_codes"), F.col("stratum"), both.alias("retrieved_by_both")]


def candidate(code: str) -> Column:
    """The reason of a row with membership and stratum: a code, SOURCE_AGREEMENT if both sources hold it, and its stratum."""
    return F.struct(*_candidate(code))


def entity(code: str, minimum: int) -> Column:
    """The reason of a row that also has family, name, support and high of a liked entity, with the tier of its evidence."""
    return F.struct(*_candidate(code), "family", "name", "support", "high", R.evidence_tier(F.col("support"), minimum).alias("tier"))


def shown_score(score: Column) -> Column:
    return F.round(score, 4)


def first_name(names: Column) -> Column:
    """The first of a list of names; null where it is empty or missing."""
    return F.try_element_at(names, F.lit(1))
