"""Column operators: names, new columns, scalar write-back and user transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.names import clean_names
from tablewright.functions.parsing import column
from tablewright.operators.aggregates import column_function_value
from tablewright.operators.rowindex import INDEX


def clean_columns(df: DataFrame) -> DataFrame:
    """Lower snake-case, unique column names; touches metadata only."""
    return df.toDF(*clean_names(df.columns))


def uppercase_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.upper() for name in df.columns])


def add_column(df: DataFrame, name: str | None = None, default="") -> DataFrame:
    """A new constant column; its default name counts the data columns that are there."""
    name = name or f"Column_{len([c for c in df.columns if c != INDEX]) + 1}"
    if name in df.columns:
        raise ValueError(f"column {name!r} already exists")
    return df.withColumn(name, F.lit(default))


def write_scalar(df: DataFrame, value, name: str, index: str = INDEX) -> DataFrame:
    """Puts ``value`` into the last row of column ``name``.

    A new column is of text and blank elsewhere; an existing one keeps its type and its other cells, and a value that is none of its
    type is an error. The last row is found by a scalar subquery, so the table is neither sorted nor joined.
    """
    last = df.agg(F.max(index)).scalar()
    if name not in df.columns:
        return df.withColumn(name, F.when(F.col(index) == last, F.lit(value).cast("string")).otherwise(F.lit("")))
    kind = df.schema[name].dataType
    new = F.lit(value).cast("string")
    if not isinstance(kind, T.StringType):
        if value is not None and df.sparkSession.range(1).select(new.try_cast(kind)).first()[0] is None:
            raise ValueError(f"{value!r} is no value of column {name!r} ({kind.simpleString()})")
        new = new.try_cast(kind)
    return df.withColumn(name, F.when(F.col(index) == last, new).otherwise(column(name)))


def function_to_column(df: DataFrame, fn: str, name: str, result: str, index: str = INDEX) -> DataFrame:
    """A column function whose value is written to the last row of ``result``."""
    return write_scalar(df, column_function_value(df, fn, name), result, index)


def transform(
    df: DataFrame, step: Callable[[DataFrame], DataFrame] | None = None, exprs: dict[str, str] | None = None
) -> DataFrame:
    """The user's own step: a DataFrame function, or SQL expressions per (new) column.

    Expressions see the table as it was, stay inside the optimizer and cannot run foreign code.
    """
    if step is not None:
        df = df.transform(step)
    if exprs:
        df = df.withColumns({name: F.expr(text) for name, text in exprs.items()})
    return df


def transform_batches(df: DataFrame, step: Callable, schema: str) -> DataFrame:
    """A trusted pandas step (frame in, frame out), run batch by batch inside the tasks."""

    def run(batches):
        for batch in batches:
            yield step(batch)

    return df.mapInPandas(run, schema)


def label(value: Column) -> Column:
    """A group key as chart label."""
    return value.cast("string")
