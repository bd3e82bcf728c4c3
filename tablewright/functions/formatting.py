"""Numbers and labels as display text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.parsing import column

MISSING = "—"


def safe_scalar(value: Column) -> Column:
    """NaN and infinities become NULL, the rest is rounded to 4 decimals."""
    wide = value.cast("double")
    return F.when(~F.isnan(wide) & (F.abs(wide) != float("inf")), F.round(wide, 4))


def _two_places(value: Column) -> Column:
    """At most two decimals, without trailing zeros or a trailing point."""
    text = F.round(value, 2).cast("decimal(38,2)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def indian_grouping(value: Column) -> Column:
    """``1234567.5`` becomes ``12,34,567.5``: a group of three, then groups of two."""
    text = _two_places(value)
    whole = F.regexp_extract(text, r"^(-?\d+)", 1)
    rest = F.regexp_extract(text, r"(\.\d+)$", 1)
    grouped = F.regexp_replace(whole, r"(\d)(?=(\d\d)*\d{3}$)", "$1,")
    return F.concat(grouped, rest)


def compact_number(value: Column) -> Column:
    """``1.23B``, ``4.50M``, ``7.00K``; below a thousand at most two decimals; NULL is a dash.

    Decimal input is rounded exactly; for doubles the shortest decimal form is rounded half up.
    """
    size = F.abs(value)

    def scaled(unit: int, letter: str) -> Column:
        return F.concat(F.round(value / F.lit(unit), 2).cast("decimal(38,2)").cast("string"), F.lit(letter))

    return (
        F.when(value.isNull(), F.lit(MISSING))
        .when(size >= 1_000_000_000, scaled(1_000_000_000, "B"))
        .when(size >= 1_000_000, scaled(1_000_000, "M"))
        .when(size >= 1_000, scaled(1_000, "K"))
        .otherwise(indian_grouping(value))
    )


def number_text(value: Column, whole: str = "") -> Column:
    """A double or float as a sheet shows it: shortest digits, no exponent from a millionth up to 1e21, none after the point of a whole
    number but ``whole``."""
    size, short = F.abs(value.cast("double")), value.cast("string")
    digits = F.when(size >= 1, short.try_cast("decimal(38,10)").cast("string")).otherwise(short.try_cast("decimal(38,24)").cast("string"))
    plain = F.when((size >= 1e-3) & (size < 1e7), short).otherwise(F.regexp_replace(digits, r"(\.\d*?)0+$", "$1"))
    trimmed = F.regexp_replace(plain, r"\.0?$", "")
    even = F.when(F.contains(trimmed, F.lit(".")), trimmed).otherwise(F.concat(trimmed, F.lit(whole)))
    power = F.regexp_replace(F.regexp_replace(F.regexp_replace(short, r"\.0E", "E"), "E-", "e-"), "E", "e+")
    return (
        F.when(F.isnan(value.cast("double")) | (size == float("inf")), short)
        .when(size == 0, F.lit("0" + whole))
        .when((size >= 1e21) | (size < 1e-6), power)
        .otherwise(even)
    )


def cell_text(df: DataFrame, name: str, whole: str = "") -> Column:
    """The text of a cell, NULL where it is missing or NaN; see :func:`number_text` for ``whole``."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column(name)), number_text(column(name), whole))
    return column(name).cast("string")


def date_label(value: Column) -> Column:
    """The first ten characters of a date: ``yyyy-MM-dd``."""
    return F.date_format(value, "yyyy-MM-dd")


def ranked_label(value: Column, position: Column) -> Column:
    """A label cut to 22 characters; a missing one is named after its 1-based position."""
    return F.substring(F.coalesce(value.cast("string"), F.concat(F.lit("Row "), position.cast("string"))), 1, 22)
