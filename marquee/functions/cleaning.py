"""Cleaning expressions: strings and raw fields to typed, validated columns."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_string(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def safe_double(c: Column) -> Column:
    """A number; blank, malformed and NaN become null."""
    d = F.trim(c).try_cast("double")
    return F.when(~F.isnan(d), d)


def safe_int(c: Column) -> Column:
    """Through double, so that 12.0 is 12 and 12.7 is 12."""
    return safe_double(c).try_cast("bigint")


def parse_list(c: Column) -> Column:
    """A serialised list of names as an array of trimmed non-blank strings; malformed text gives an empty array."""
    repaired = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), '""', '"'), r"\s+$", "")
    names = F.transform(F.from_json(repaired, "array<string>"), lambda x: F.trim(x))
    return F.coalesce(F.filter(names, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def parse_list_exact(df: DataFrame, column: str, out: str) -> DataFrame:
    """As parse_list, by Python's literal grammar: entries that aren't strings are dropped, not turned into text."""

    def one(text: str | None) -> list[str]:
        try:
            got = ast.literal_eval((text or "").strip().strip('"').replace('""', '"'))
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return []
        return [x.strip() for x in got if isinstance(x, str) and x.strip()] if isinstance(got, list | tuple) else []

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([one(t) for t in b.column(column).to_pylist()], pa.list_(pa.string()))], [*b.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, `{out}` array<string>")


def names_set(names: Column) -> Column:
    """Trimmed non-blank distinct names, in order of first sight."""
    return F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def names_of_type(items: Column, kind: str) -> Column:
    """Distinct names of array<struct<type, name>> entries of a type."""
    return names_set(F.transform(F.filter(items, lambda x: x["type"] == kind), lambda x: x["name"]))


def title_key(c: Column) -> Column:
    """White space collapsed, lower case; the sharp s counts as ss. Other full case folding isn't done."""
    return F.replace(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), F.lit("ß"), F.lit("ss"))


def parse_year(c: Column) -> Column:
    y = F.trim(c).try_cast("int")
    return F.when(y > 0, y)


def parse_rating(c: Column) -> Column:
    """A rating text in half steps from 0.5 to 5.0; anything else null."""
    d = F.trim(c).try_cast("decimal(10,4)")
    return F.when((d * 2 == F.floor(d * 2)) & d.between(0.5, 5), d.cast("double"))


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("bigint")


def decade_label(year: Column) -> Column:
    return F.concat(decade(year).cast("string"), F.lit("s"))


def admission(title: Column, external_id: Column, ratings: Column, minimum: int = 1000) -> Column:
    """FAILED without title, id or count; FILTERED under the minimum; else SUCCESS."""
    return F.when(title.isNull() | external_id.isNull() | ratings.isNull(), "FAILED").when(ratings < minimum, "FILTERED").otherwise("SUCCESS")


def valid_average(c: Column) -> Column:
    return F.when(~F.isnan(c) & c.between(0, 5), c)


def valid_count(c: Column) -> Column:
    return F.when((c >= 0) & (c == F.floor(c)), c.cast("bigint"))


def refresh_years(day: Column) -> Column:
    """January: the year before; July: that and this year; any other month fails the query."""
    y = F.year(day)
    wrong = F.raise_error(F.lit("the catalog is refreshed in January and July only")).cast("array<int>")
    return F.when(F.month(day) == 1, F.array(y - 1)).when(F.month(day) == 7, F.array(y - 1, y)).otherwise(wrong)


def sanitised(c: Column) -> Column:
    return F.replace(c, F.lit(";"), F.lit(","))
