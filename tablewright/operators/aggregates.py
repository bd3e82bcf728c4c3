"""Column functions, KPI rows, group sums, value counts, shares and cell formulas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType

from tablewright.functions import names
from tablewright.functions.formatting import cell_text, number_text, safe_scalar
from tablewright.functions.parsing import column, currency, double_of, is_text_type, prefix, present
from tablewright.operators.distinct import distinct_counts
from tablewright.operators.quantiles import exact_median
from tablewright.operators.rowindex import INDEX

# The supported column functions and the KPI statistics.
FUNCTIONS = ["SUM", "AVG", "AVERAGE", "MAX", "MIN", "COUNT", "MEDIAN", "STDEV", "VARIANCE"]
KPI_STATS = ["sum", "mean", "min", "max", "std"]
MAX_KPIS = 3
BAR_SIZE = 15
PIE_SIZE = 10
MERGE_ABOVE = 7
MERGE_SHARE = 0.02
LABEL_WHOLE = ".0"  # how group labels spell whole numbers of a column with fractions


def _aggregate(fn: str, v: Column) -> Column:
    return {
        "SUM": F.sum,
        "AVG": F.avg,
        "AVERAGE": F.avg,
        "MAX": F.max,
        "MIN": F.min,
        "COUNT": F.count,
        "STDEV": F.stddev_pop,
        "VARIANCE": F.var_pop,
    }[fn](v)


def column_function(df: DataFrame, fn: str, name: str) -> DataFrame:
    """One row ``(function, column, result)`` over the cells that read as numbers.

    Deviation and variance are those of the population. The result is NULL when no cell is numeric;
    :func:`column_function_value` raises instead.
    """
    fn = fn.upper()
    if fn not in FUNCTIONS:
        raise ValueError(f"supported functions: {', '.join(FUNCTIONS)}")
    if name not in df.columns:
        raise ValueError(f"column {name!r} not found")
    dtype = df.schema[name].dataType
    if is_text_type(dtype):
        value = currency(column(name))
    elif isinstance(dtype, BooleanType):  # a truth value is no number here
        value = F.lit(None).cast("double")
    else:
        value = finite(double_of(df, name))
    if fn == "MEDIAN":
        found = exact_median(df, value).select(F.col("median").alias("_r"))
    else:
        found = df.agg(_aggregate(fn, value).alias("_r"))
    return found.select(
        F.lit(fn).alias("function"), F.lit(name).alias("column"), F.round(F.col("_r").cast("double"), 4).alias("result")
    )


def finite(value: Column) -> Column:
    return F.when(F.abs(value) != float("inf"), value)


def column_function_value(df: DataFrame, fn: str, name: str) -> float:
    found = column_function(df, fn, name).first()
    if found is None or found["result"] is None or (fn.upper() == "COUNT" and found["result"] == 0):
        raise ValueError(f"no numeric values in {name!r}")
    return found["result"]


def kpi_block(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows ``(column, position, stat, value)`` for the given columns, all of them; sample deviation.

    One aggregate over all columns, unpivoted from its single row; columns without a value drop out.
    """
    shown = columns
    if not shown:
        return df.sparkSession.createDataFrame([], "column string, position int, stat string, value double")
    stats, unpivot = [], []
    for i, name in enumerate(shown):
        v = double_of(df, name)
        stats.append(F.array(F.sum(v), F.avg(v), F.min(v), F.max(v), F.stddev_samp(v)).alias(f"k{i}"))
        unpivot += [F.lit(name), F.lit(i), F.col(f"k{i}")]
    per_column = df.agg(*stats).select(F.stack(F.lit(len(shown)), *unpivot).alias("column", "position", "stats"))
    names = F.array(*[F.lit(stat) for stat in KPI_STATS])
    return (
        per_column.where("stats[0] is not null")
        .select("column", "position", F.explode(F.arrays_zip(names.alias("stat"), F.col("stats").alias("value"))).alias("_s"))
        .select("column", "position", F.col("_s.stat").alias("stat"), safe_scalar(F.col("_s.value")).alias("value"))
    )


def null_cells(df: DataFrame) -> DataFrame:
    """One row ``(rows, cells, nulls, null_pct)``; NaN counts as missing."""
    nulls = [F.count_if(present(df, c).isNull()) for c in df.columns]
    total = nulls[0]
    for n in nulls[1:]:
        total = total + n
    cells = F.col("rows") * len(df.columns)
    return df.agg(F.count("*").alias("rows"), total.alias("nulls")).select(
        "rows",
        cells.alias("cells"),
        "nulls",
        F.coalesce(F.round(F.try_divide(F.col("nulls"), cells) * 100, 2), F.lit(0.0)).alias("null_pct"),
    )


def distinct_count(df: DataFrame, name: str) -> DataFrame:
    """``n_distinct``: how many values a column has; -0.0 is 0.0, and NaN no value."""
    cell = present(df, name)
    if isinstance(df.schema[name].dataType, (DoubleType, FloatType)):
        cell = cell + F.lit(0.0)
    return distinct_counts(df, [cell]).agg(F.coalesce(F.max("n_distinct"), F.lit(0)).alias("n_distinct"))


def _ranked(top: DataFrame, *order: Column) -> DataFrame:
    """1-based ``rank`` for a result that is already cut to a few rows."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def group_sum_top(df: DataFrame, x: str, y: str, k: int = BAR_SIZE, summed: bool = False) -> DataFrame:
    """``(rank, label, value)``: largest sums of ``y`` per value of ``x`` over complete rows.

    ``summed`` says that ``y`` already holds sums, of which a NaN (of infinities) counts as one.
    """
    values = column(y) if summed else double_of(df, y)
    pairs = df.select(present(df, x).alias(x), values.alias("_y")).where(column(x).isNotNull() & F.col("_y").isNotNull())
    sums = pairs.groupBy(column(x)).agg(F.sum("_y").alias("_sum"))
    top = (
        sums.select(cell_text(sums, x, LABEL_WHOLE).alias("label"), "_sum")
        .orderBy(F.desc("_sum"), "label")
        .limit(k)
    )
    return _ranked(top, F.desc("_sum"), F.col("label")).select("rank", "label", safe_scalar(F.col("_sum")).alias("value"))


def value_counts_top(df: DataFrame, x: str, k: int = PIE_SIZE, weight: str | None = None) -> DataFrame:
    """``(rank, label, n)``: most frequent values as text, nulls left out.

    ``weight`` names a column of row counts when ``df`` is already an aggregate.
    """
    rows = F.col(weight) if weight else F.lit(1)
    top = (
        df.select(cell_text(df, x, LABEL_WHOLE).alias("label"), rows.cast("long").alias("_rows"))
        .where("label is not null")
        .groupBy("label")
        .agg(F.sum("_rows").alias("n"))
        .orderBy(F.desc("n"), "label")
        .limit(k)
    )
    return _ranked(top, F.desc("n"), F.col("label")).select("rank", "label", "n")


def merge_small(slices: DataFrame) -> DataFrame:
    """``(rank, label, n)`` with slices under 2% folded into ``Other`` if more than 7 are shown.

    ``slices`` is a top list of a few rows; the total is that of the shown slices. Folding is one
    pass: each small slice takes the label ``Other``.
    """
    shown = Window.partitionBy(F.lit(0))
    total = F.sum("n").over(shown)
    small = (F.count("*").over(shown) > MERGE_ABOVE) & (F.col("n") < F.col("_total") * MERGE_SHARE)
    folded = (
        slices.withColumn("_total", total)
        .withColumn("_small", small)
        .groupBy(
            F.when(F.col("_small"), F.lit("Other")).otherwise(F.col("label")).alias("label"),
            F.col("_small"),
        )
        .agg(F.sum("n").alias("n"), F.min("rank").alias("_first"))
    )
    return _ranked(folded, F.col("_first")).select("rank", "label", "n")


def share_of_total(slices: DataFrame, value: str = "n") -> DataFrame:
    """Adds ``total`` and ``share`` (percent, one decimal) to a top list of a few rows."""
    total = F.sum(value).over(Window.partitionBy(F.lit(0)))
    return slices.withColumn("total", total).withColumn(
        "share", F.round(F.try_divide(F.col(value), F.col("total")) * 100, 1)
    )


# -- cell formulas ------------------------------------------------------------------------------

# How a formula and a cell are written.
_CALL = re.compile(r"^=\s*([A-Z]+)\((.+)\)$", re.IGNORECASE | re.DOTALL)
_CELL = re.compile(r"^([A-Z]+)(\d+)$", re.IGNORECASE)
# Functions a cell formula knows (population deviation and variance).
FORMULAS = ["SUM", "AVERAGE", "COUNT", "MAX", "MIN", "MEDIAN", "STDEV", "VARIANCE"]


def cell_formula(df: DataFrame, text: str, columns: list[str] | None = None, index: str = INDEX) -> DataFrame:
    """One row ``(formula, result)`` for text such as ``=SUM(A1,B2,3)``.

    ``A1`` is the first of ``columns`` in the row whose index is 0. A cell that is missing or does
    not start with a number is 0. Text that is no formula is returned as it is; an unknown function
    gives ``#NAME?``. Only the addressed rows and columns are read, in one aggregate.
    """
    columns = columns or [c for c in df.columns if c != index]
    spark = df.sparkSession

    def constant(result: str) -> DataFrame:
        return spark.createDataFrame([(text, result)], "formula string, result string")

    if not text.startswith("="):
        return constant(text)
    call = _CALL.match(text.strip())
    if not call or call.group(1).upper() not in FORMULAS:
        return constant("#NAME?")
    operands: list[tuple[int, str] | Column] = []
    for argument in call.group(2).split(","):
        cell = _CELL.match(argument.strip())
        if not cell:
            operands.append(F.coalesce(prefix(F.lit(argument)), F.lit(0.0)))
            continue
        at = names.position(cell.group(1))
        operands.append((int(cell.group(2)) - 1, columns[at]) if at < len(columns) else F.lit(0.0))

    refs = [o for o in operands if isinstance(o, tuple)]
    read = df.where(F.col(index).isin(sorted({row for row, _ in refs}))) if refs else df.limit(0)
    picked = [
        F.max(F.when(F.col(index) == row, F.coalesce(prefix(column(name).cast("string")), F.lit(0.0))))
        for row, name in refs
    ]
    cells = read.agg(F.count("*").alias("_rows"), *[p.alias(f"c{i}") for i, p in enumerate(picked)])
    values, at = [], 0
    for operand in operands:
        if isinstance(operand, tuple):
            values.append(F.coalesce(F.col(f"c{at}"), F.lit(0.0)))
            at += 1
        else:
            values.append(operand)
    result = _formula_result(call.group(1).upper(), F.col("_values"), len(values))
    return cells.select(F.array(*values).alias("_values")).select(
        F.lit(text).alias("formula"), number_text(result).alias("result")
    )


def _formula_result(fn: str, values: Column, n: int) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    mean = total / n
    spread = F.aggregate(F.transform(values, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda acc, v: acc + v) / n
    ordered = F.array_sort(values)
    middle = (F.element_at(ordered, (n + 1) // 2) + F.element_at(ordered, n // 2 + 1)) / 2
    if fn == "COUNT":
        return F.lit(n).cast("double")
    if fn == "MAX":
        return F.array_max(values)
    if fn == "MIN":
        return F.array_min(values)
    exact = {"SUM": total, "AVERAGE": mean, "MEDIAN": middle, "STDEV": F.sqrt(spread), "VARIANCE": spread}
    return F.round(exact[fn], 4)
