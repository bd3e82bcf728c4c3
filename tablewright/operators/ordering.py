"""Sorting, paging, top rows and previews; every order ends in a tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.formatting import safe_scalar
from tablewright.functions.parsing import column, double_of, is_number_type, is_text_type, prefix, present
from tablewright.operators.rowindex import INDEX, dense_index

# Fixed values of paging and top lists.
PAGE_SIZE = 100
MAX_PAGE_SIZE = 500
TOP_ROWS = 5
TOP_CATEGORIES = 2
TOP_NUMBERS = 3
PREVIEW_ROWS = 5


SORT_KEYS = ["_number", "_text"]
#: The collation of texts: the root order of Unicode, by letters, accents and case.
TEXT_ORDER = "UNICODE"


def with_mixed_keys(df: DataFrame, name: str) -> DataFrame:
    """Adds the sort keys of a mixed column: its leading number, else its text as readers order it.

    Texts are compared by the Unicode collation: letters first, then accents, then case (``eclair < Eclair < éclair``). As columns
    the keys are computed once, however often the sort samples, shuffles and compares them.
    """
    c = column(name)
    if is_number_type(df.schema[name].dataType):
        return df.withColumns({"_number": c.cast("double"), "_text": F.lit(None).cast("string")})
    keyed = df.withColumn("_number", prefix(c.cast("string")))
    return keyed.withColumn("_text", F.when(F.col("_number").isNull(), F.collate(c.cast("string"), TEXT_ORDER)))


def mixed_order(ascending: bool = True) -> list[Column]:
    """Numbers first, then text, missing cells last."""
    return [F.asc_nulls_last(k) if ascending else F.desc_nulls_last(k) for k in SORT_KEYS]


def sort_rows(df: DataFrame, name: str, ascending: bool = True, tie: list[str] | None = None) -> DataFrame:
    """The whole table in mixed order. The unique tie-break also lets Spark cut a hot value's rows
    across the range partitions of the sort."""
    order = [*mixed_order(ascending), *[column(t) for t in (tie or [INDEX])]]
    return with_mixed_keys(df, name).orderBy(*order).drop(*SORT_KEYS)


def sorted_index(df: DataFrame, name: str, ascending: bool, tie: list[str], index: str = INDEX) -> DataFrame:
    """The table with ``index`` numbering it in mixed order."""
    order = [*mixed_order(ascending), *[column(t) for t in tie]]
    return dense_index(with_mixed_keys(df, name), order, index).drop(*SORT_KEYS)


def _check_page(number: int, size: int) -> None:
    if number < 1:
        raise ValueError("pages start at 1")
    if not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"a page has 1 to {MAX_PAGE_SIZE} rows, not {size}")


def page(df: DataFrame, number: int = 1, size: int = PAGE_SIZE, index: str = INDEX) -> DataFrame:
    """Rows of a 1-based page by index range: a pushed-down filter, not an offset that is skipped."""
    _check_page(number, size)
    return viewport(df, (number - 1) * size, number * size, index)


def page_info(df: DataFrame, number: int = 1, size: int = PAGE_SIZE, index: str = INDEX) -> DataFrame:
    """One row ``(count, page, next, previous)`` for a page."""
    _check_page(number, size)
    return df.agg(F.count("*").alias("count")).select(
        "count",
        F.lit(number).alias("page"),
        F.when(F.col("count") > number * size, F.lit(number + 1)).alias("next"),
        F.lit(number - 1 if number > 1 else None).cast("int").alias("previous"),
    )


def viewport(df: DataFrame, start: int, stop: int, index: str = INDEX) -> DataFrame:
    """Rows ``start <= index < stop``."""
    return df.where((F.col(index) >= start) & (F.col(index) < stop))


def preview(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    return df.orderBy(*[column(c) for c in order_by or [INDEX]]).limit(PREVIEW_ROWS)


def top_rows(df: DataFrame, by: str, columns: list[str], tie: list[str], k: int = TOP_ROWS) -> DataFrame:
    """``(rank, *columns)``: the ``k`` rows with the largest ``by``, missing values last.

    Numbers are rounded to 4 decimals; missing text is blank. Each task keeps only its own ``k``
    rows before they are merged.
    """
    order = [F.desc_nulls_last("_key"), *[column(t) for t in tie]]
    top = df.withColumn("_key", double_of(df, by)).orderBy(*order).limit(k)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))

    def shown(name: str) -> Column:
        dtype = df.schema[name].dataType
        if is_number_type(dtype):
            return safe_scalar(column(name)).alias(name)
        if name == by:
            return safe_scalar(F.col("_key")).alias(name)
        value = column(name) if is_text_type(dtype) else present(df, name).cast("string")
        return F.coalesce(value, F.lit("")).alias(name)

    return ranked.select("rank", *[shown(c) for c in columns])


def top_columns(categorical: list[str], numbers: list[str], every: list[str]) -> list[str]:
    """Columns of a top list: two categorical and three numeric ones."""
    return categorical[:TOP_CATEGORIES] + numbers[:TOP_NUMBERS] or every[:PREVIEW_ROWS]


def stride(df: DataFrame, above: int = 150, target: int = 100, index: str = INDEX) -> DataFrame:
    """Every ``ceil(n / target)``-th row of a dense table that has more than ``above`` rows."""
    n = df.agg(F.count("*")).scalar()
    step = F.when(n > above, F.ceil(n / target)).otherwise(F.lit(1))
    return df.where(F.col(index) % step == 0)
