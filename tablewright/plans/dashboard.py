"""The automatic dashboard: profile the table, choose the columns, build every section in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.parsing import column, double_of, is_number_type, quoted
from tablewright.operators.aggregates import MAX_KPIS, group_sum_top, kpi_block, merge_small, value_counts_top
from tablewright.operators.ordering import top_columns, top_rows
from tablewright.operators.profile import TableProfile, coerce, profile
from tablewright.operators.timeseries import daily_sums, trend_of_days
from tablewright.session import cut, stored

SCHEMA = "section string, item string, position int, label string, value double"
# The shared category-by-day table is built only when it cannot have more rows than this; results are the same.
SHARED_ROWS = 2_000_000


def _text(value: str) -> str:
    """A string as an SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _long(df: DataFrame, section: str, item: str, position: str, label: str, value: str) -> DataFrame:
    """The five columns of the result from SQL expressions."""
    return df.selectExpr(
        f"'{section}' AS section",
        f"CAST({item} AS STRING) AS item",
        f"CAST({position} AS INT) AS position",
        f"CAST({label} AS STRING) AS label",
        f"CAST({value} AS DOUBLE) AS value",
    )


def dashboard(
    df: DataFrame,
    name: str = "",
    measure: str | None = None,
    dimension: str | None = None,
    time: str | None = None,
    order_by: list[str] | None = None,
    money: bool = False,
    found: TableProfile | None = None,
) -> DataFrame:
    """Sections ``meta``, ``kpi``, ``bar``, ``line``, ``pie`` and ``top`` as one long DataFrame.

    The columns are the first numeric, categorical and date ones unless named. Sections whose roles
    are missing are left out. ``order_by`` (unique columns) breaks ties and orders first values.
    """
    found = found or profile(df, order_by, money)
    if found.rows == 0:
        raise ValueError("the table is empty")
    typed = coerce(df, found, money)
    numbers = found.of_role("numeric")
    if measure:
        numbers = [measure] + [n for n in numbers if n != measure]
    categories = found.of_role("categorical")
    if dimension:
        categories = [dimension] + [c for c in categories if c != dimension]
    days = found.of_role("date")
    x = categories[0] if categories else None
    y = numbers[0] if numbers else None
    d = time or (days[0] if days else None)

    columns = top_columns(categories, numbers, df.columns)
    typed, span = _parsed_once(df, typed, found, [x, y, d, *numbers[:MAX_KPIS], *columns, *(order_by or [])], d)

    sections = [_meta(df, name, found, x, y, d)]
    if numbers:
        k = kpi_block(typed, numbers[:MAX_KPIS])
        sections.append(_long(k, "kpi", "column", "position", "stat", "value"))
    shared = _shared(typed, found, x, y, d, span)
    if x and y:
        bars = group_sum_top(shared, x, "_sum", summed=True) if shared else group_sum_top(typed, x, y)
        sections.append(_long(bars, "bar", _text(x), "rank - 1", "label", "value"))
    if d and y:
        sections.append(_line(_daily(typed, shared, d, y), y))
    if x:
        counts = value_counts_top(shared, x, weight="_rows") if shared else value_counts_top(typed, x)
        pie = merge_small(counts)
        sections.append(_long(pie, "pie", _text(x), "rank - 1", "label", "n"))
    if numbers:
        sections.append(_top(typed, y, columns, order_by))
    return reduce(DataFrame.unionByName, sections)


def _meta(df: DataFrame, name: str, found: TableProfile, x, y, d) -> DataFrame:
    rows = [
        ("meta", "name", 0, name, None),
        ("meta", "rows", 0, None, float(found.rows)),
        ("meta", "cols", 0, None, float(len(found.columns))),
        ("meta", "null_pct", 0, None, found.null_pct()),
    ]
    rows += [("meta", key, 0, col, None) for key, col in (("dimension", x), ("measure", y), ("time", d)) if col]
    for role in ("numeric", "categorical", "date"):
        rows += [("meta", f"{role}_cols", i, c, None) for i, c in enumerate(found.of_role(role))]
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def _parsed_once(
    df: DataFrame, typed: DataFrame, found: TableProfile, used: list, d: str | None
) -> tuple[DataFrame, int | None]:
    """The columns the sections use, and the days between the first and last date.

    Columns that had to be parsed from text are written once, so that the sections do not each parse
    them again; a table that already has types is read in place.
    """
    names = list(dict.fromkeys(name for name in used if name))
    span = next((c.days for c in found.columns if c.name == d), None)
    if all(df.schema[n].dataType == typed.schema[n].dataType for n in names):
        return typed, span
    kept = stored(typed.select(*[column(n) for n in names]))
    if d and span is None:
        span = kept.agg(F.date_diff(F.max(column(d)), F.min(column(d)))).first()[0]
    return kept, span


def _shared(typed: DataFrame, found: TableProfile, x, y, d, span: int | None) -> DataFrame | None:
    """Sums and counts per category and day, if provably small: bars, pie and line then share one scan.

    The bound is the exact number of categories times the days between the first and last date.
    """
    if not (x and y and d) or x == y:
        return None
    profiled = {c.name: c for c in found.columns}
    categories = profiled[x].n_distinct
    if categories is None or span is None or (categories + 1) * (span + 1) > SHARED_ROWS:
        return None
    v = double_of(typed, y)
    return cut(
        typed.groupBy(column(x), F.to_date(column(d)).alias("_day")).agg(
            F.sum(v).alias("_sum"), F.count(v).alias("_n"), F.count("*").alias("_rows")
        )
    )


def _daily(typed: DataFrame, shared: DataFrame | None, d: str, y: str) -> DataFrame:
    if shared is None:
        return daily_sums(typed, column(d), double_of(typed, y))
    known = shared.where("_day is not null and _n > 0")
    return known.groupBy("_day").agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))


def _line(days: DataFrame, y: str) -> DataFrame:
    """Series and trend, unpivoted from one plan."""
    shown = f"stack(2, {_text(y)}, value, {_text(y + ' Trend')}, trend) AS (item, shown)"
    series = trend_of_days(days).selectExpr("position", "period", shown)
    return _long(series, "line", "item", "position", "period", "shown")


def _top(typed: DataFrame, by: str, columns: list[str], order_by: list[str] | None) -> DataFrame:
    top = top_rows(typed, by, columns, order_by or columns)
    cells = []
    for name in columns:
        cell = quoted(name)
        number = is_number_type(typed.schema[name].dataType)
        cells.append(f"{_text(name)}, {'NULL' if number else cell}, {f'CAST({cell} AS DOUBLE)' if number else 'NULL'}")
    long = top.selectExpr("rank", f"stack({len(columns)}, {', '.join(cells)}) AS (item, label, value)")
    return _long(long, "top", "item", "rank - 1", "label", "value")


def typed_table(df: DataFrame, order_by: list[str] | None = None, money: bool = False) -> DataFrame:
    """The table with numeric and date text columns parsed, by its own profile."""
    return coerce(df, profile(df, order_by, money), money)
