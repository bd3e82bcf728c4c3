"""Row filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.formatting import cell_text
from tablewright.functions.parsing import present
from tablewright.operators.rowindex import INDEX


def search(df: DataFrame, text: str, columns: list[str] | None = None, index: str = INDEX) -> DataFrame:
    """Rows where the text form of any cell contains ``text``, ignoring case; empty text keeps all.

    Numbers are written out without an exponent; whole ones of a column with fractions are found with and without ``.0``.
    """
    if not text:
        return df
    columns = columns or [c for c in df.columns if c != index]
    needle = F.lit(text.lower())
    hits = [F.contains(F.lower(cell_text(df, c, ".0")), needle) for c in columns]
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits]))


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where none of ``columns`` is NULL or NaN."""
    return df.where(reduce(lambda a, b: a & b, [present(df, c).isNotNull() for c in columns]))


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("the table is empty")
    return df
