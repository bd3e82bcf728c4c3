"""Lenient text-to-value parsing as JVM-side column expressions.

Every parser returns NULL for text it does not accept and never raises, also in ANSI mode. The
patterns are checked before the cast because Spark's own cast accepts forms such as ``1d`` and
``0x1p3`` that a spreadsheet number is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a number in each dialect.
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
CURRENCY = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"
FLOAT_LITERAL = (
    r"^\s*[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?"
    r"|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"
)
PREFIX = r"^\s*([+-]?(Infinity|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?))"


def numeric(text: Column) -> Column:
    """Whole-text number; surrounding whitespace, exponents and ``inf`` are accepted."""
    return F.when(text.rlike(NUMBER), F.btrim(text, F.lit(" \t\n\x0b\f\r")).try_cast("double"))


def currency(text: Column) -> Column:
    """Number after dropping every ``,`` and ``$``; ``nan`` and ``inf`` are not values."""
    bare = F.translate(text, ",$", "")
    digits = F.btrim(F.translate(bare, "_", ""), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare.rlike(CURRENCY), digits.try_cast("double"))


def prefix(text: Column) -> Column:
    """Leading number of a text (``12abc`` gives 12), else NULL."""
    # Blank means no match; a NULL is cheaper to cast than a blank, which fails by an exception.
    return F.nullif(F.regexp_extract(text, PREFIX, 1), F.lit("")).try_cast("double")


def chart_value(text: Column) -> Column:
    """Chart axis value: currency signs dropped, leading number taken, anything else is 0."""
    return F.coalesce(prefix(F.translate(text, ",$", "")), F.lit(0.0))


def is_number_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_time_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_text_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def quoted(name: str) -> str:
    """A column name as an identifier, safe for names with dots and spaces."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def double_of(df: DataFrame, name: str, parse=numeric) -> Column:
    """A column as DOUBLE by its schema type; NaN counts as missing, text goes through ``parse``."""
    dtype, c = df.schema[name].dataType, column(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c.cast("double"))
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    if is_text_type(dtype):
        return parse(c)
    return F.lit(None).cast("double")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL; other types unchanged."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column(name)), column(name))
    return column(name)
