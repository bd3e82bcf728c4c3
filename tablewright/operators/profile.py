"""Column roles from the data: numeric, date, categorical, text, nested or empty.

The first scan counts values, parsable numbers and date-like texts. Date-like columns are read again
to choose a format and count by it, and the other non-numeric texts to count distinct values, by digests, so texts
are never shuffled. Columns whose Spark type decides the role cost one counter each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import dates
from tablewright.functions.parsing import (
    column,
    currency,
    double_of,
    is_number_type,
    is_text_type,
    is_time_type,
    numeric,
    present,
)
from tablewright.operators.distinct import distinct_counts

# The share rules.
NUMERIC_SHARE = 0.7
DATE_SHARE = 0.6
CATEGORY_FLOOR = 50
CATEGORY_SHARE = 0.3

ROLES = ["numeric", "date", "categorical", "text", "nested", "empty"]
PROFILE_SCHEMA = (
    "col string, pos int, n bigint, n_num bigint, n_date bigint, n_distinct bigint, role string, date_format string"
)


@dataclass
class ColumnProfile:
    """What one scan learned about a column; ``n`` counts non-null cells, ``days`` spans its dates."""

    name: str
    pos: int
    n: int = 0
    n_num: int = 0
    n_date: int = 0
    n_distinct: int | None = None
    role: str = "text"
    date_format: str | None = None
    days: int | None = None


@dataclass
class TableProfile:
    rows: int
    columns: list[ColumnProfile]

    def of_role(self, role: str) -> list[str]:
        return [c.name for c in self.columns if c.role == role]

    def null_pct(self) -> float:
        """Share of cells without a value after typing, in percent: unparsable cells count."""
        valid = {"numeric": "n_num", "date": "n_date"}
        filled = sum(getattr(c, valid.get(c.role, "n")) for c in self.columns)
        cells = self.rows * len(self.columns)
        return round((cells - filled) / cells * 100, 2) if cells else 0.0


def category_limit(n: int) -> float:
    return max(CATEGORY_FLOOR, CATEGORY_SHARE * n)


def profile(df: DataFrame, order_by: list[str] | None = None, money: bool = False) -> TableProfile:
    """Profiles every column by a few aggregate jobs.

    A date column is read by the format of its first value in ``order_by`` order. Without an order
    key the candidates are the formats of its smallest and largest value, and the one that parses
    more cells wins. ``money`` also accepts numbers with ``$`` and ``,``.
    """
    parse = currency if money else numeric
    fields = df.schema.fields
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(fields):
        c = column(field.name)
        aggs.append(F.count(present(df, field.name)).alias(f"n{i}"))
        if is_time_type(field.dataType):
            aggs.append(F.date_diff(F.max(c), F.min(c)).alias(f"days{i}"))
        elif is_text_type(field.dataType):
            aggs.append(F.count(parse(c)).alias(f"num{i}"))
            aggs.append(F.count_if((F.length(c) >= dates.SHORTEST) & c.rlike(dates.SHAPE)).alias(f"shape{i}"))
    first_scan = df.agg(*aggs).first()

    found, open_text = [], []
    for i, field in enumerate(fields):
        p = ColumnProfile(field.name, i, n=first_scan[f"n{i}"])
        found.append(p)
        if p.n == 0:
            p.role = "empty"
        elif is_number_type(field.dataType):
            p.role, p.n_num = "numeric", p.n
        elif is_time_type(field.dataType):
            p.role, p.n_date, p.days = "date", p.n, first_scan[f"days{i}"]
        elif not is_text_type(field.dataType):
            p.role = "nested"
        else:
            p.n_num = first_scan[f"num{i}"]
            if p.n_num / p.n >= NUMERIC_SHARE:
                p.role = "numeric"
            else:
                open_text.append(p)
    _find_dates(df, [p for p in open_text if first_scan[f"shape{p.pos}"] / p.n >= DATE_SHARE], order_by)
    _find_categories(df, [p for p in open_text if p.role == "text"])
    return TableProfile(first_scan["rows"], found)


def _order_key(order_by: list[str]) -> Column:
    return column(order_by[0]) if len(order_by) == 1 else F.struct(*[column(c) for c in order_by])


def _find_dates(df: DataFrame, texts: list[ColumnProfile], order_by: list[str] | None) -> None:
    """Marks date-like text columns of which enough cells parse by one format."""
    if not texts:
        return
    samples = []
    for p in texts:
        c = column(p.name)
        if order_by:
            samples.append(F.array(F.min_by(c, F.when(c.isNotNull(), _order_key(order_by)))).alias(f"s{p.pos}"))
        else:
            samples.append(F.array(F.min(c), F.max(c)).alias(f"s{p.pos}"))
    seen = df.agg(*samples).first()
    tallies, tried = [], {}
    for p in texts:
        candidates = {dates.format_of(v) for v in seen[f"s{p.pos}"]} - {None}
        tried[p.pos] = sorted(candidates, key=dates.FORMATS.index)
        tallies += [F.count(fmt.parse(column(p.name))).alias(f"d{p.pos}_{k}") for k, fmt in enumerate(tried[p.pos])]
    if not tallies:
        return
    counts = df.agg(*tallies).first()
    for p in texts:
        for k, fmt in enumerate(tried[p.pos]):
            hits = counts[f"d{p.pos}_{k}"]
            if hits > p.n_date:
                p.n_date, p.date_format = hits, fmt.name
        if p.n_date / p.n >= DATE_SHARE:
            p.role = "date"
        else:
            p.date_format = None


def _find_categories(df: DataFrame, texts: list[ColumnProfile]) -> None:
    """Counts distinct values of text columns, and marks those with few."""
    if not texts:
        return
    counts = {r["place"]: r["n_distinct"] for r in distinct_counts(df, [column(p.name) for p in texts]).collect()}
    for i, p in enumerate(texts):
        p.n_distinct = counts.get(i, 0)
        if p.n_distinct <= category_limit(p.n):
            p.role = "categorical"


def profile_frame(df: DataFrame, order_by: list[str] | None = None, money: bool = False) -> DataFrame:
    """The profile as a DataFrame with one row per column."""
    rows = [
        (c.name, c.pos, c.n, c.n_num, c.n_date, c.n_distinct if c.role == "categorical" else None, c.role, c.date_format)
        for c in profile(df, order_by, money).columns
    ]
    return df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)


def coerce(df: DataFrame, found: TableProfile, money: bool = False) -> DataFrame:
    """Numeric and date columns replaced by their parsed values; the rest only loses NaN."""
    typed = []
    for c in found.columns:
        if c.role == "numeric" and is_text_type(df.schema[c.name].dataType):
            value = double_of(df, c.name, currency if money else numeric)
        elif c.role == "date" and c.date_format:
            value = dates.parse_date(column(c.name), c.date_format)
        else:
            value = present(df, c.name)
        typed.append(value.alias(c.name))
    return df.select(*typed)


def role_counts(found: DataFrame) -> DataFrame:
    """Columns per role, from a profile frame."""
    return found.groupBy("role").agg(F.count("*").alias("n_cols"))




def parse_dates(df: DataFrame, names: list[str], order_by: list[str]) -> dict[str, Column]:
    """Text columns read by the format of their first non-null value; other cells are NULL."""
    key = _order_key(order_by)
    cells = [column(name) for name in names]
    first = df.agg(*[F.min_by(c, F.when(c.isNotNull(), key)) for c in cells]).first()
    formats = [dates.format_of(value) for value in first]
    return {
        name: fmt.parse(c) if fmt else F.lit(None).cast("timestamp_ntz") for name, c, fmt in zip(names, cells, formats)
    }
