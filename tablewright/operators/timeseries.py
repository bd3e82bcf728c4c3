"""Resampling to days, weeks or months with gap filling, rolling trend and direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.formatting import date_label, safe_scalar

# More complete rows than this give months, or else weeks; and the shown length.
MONTHLY_ABOVE = 500
WEEKLY_ABOVE = 120
LAST_PERIODS = 60
MIN_WINDOW = 3
FREQUENCIES = {"D": "daily", "W": "weekly", "M": "monthly"}
FREQUENCY = f"CASE WHEN {{n}} > {MONTHLY_ABOVE} THEN 'M' WHEN {{n}} > {WEEKLY_ABOVE} THEN 'W' ELSE 'D' END"


def daily_sums(df: DataFrame, time: Column, value: Column) -> DataFrame:
    """``(_day, _sum, _n)`` over rows that have both; the only step that reads the table."""
    return (
        df.select(time.alias("_time"), value.cast("double").alias("_value"))
        .na.drop()
        .groupBy(F.to_date("_time").alias("_day"))
        .agg(F.sum("_value").alias("_sum"), F.count("*").alias("_n"))
    )


def resample(
    df: DataFrame, time: Column, value: Column, freq: str | None = None, last: int = LAST_PERIODS
) -> DataFrame:
    """``(position, period, freq, value, trend)``: sums per period, oldest first.

    Weeks end on, and are labelled by, their Sunday; months by their last day. Periods without rows
    are 0. With ``freq=None`` the number of complete rows picks the frequency, inside the plan. The
    table is reduced to one row per calendar day first; all windows run on those few rows.
    """
    if freq is not None and freq not in FREQUENCIES:
        raise ValueError(f"frequency must be one of {sorted(FREQUENCIES)}")
    return trend_of_days(daily_sums(df, time, value), freq, last)


def trend_of_days(days: DataFrame, freq: str | None = None, last: int = LAST_PERIODS) -> DataFrame:
    """:func:`resample` from daily sums; their number is bounded by the calendar."""
    chosen = f"'{freq}'" if freq else FREQUENCY.format(n="sum(_n) OVER ()")
    # A period is identified by its label for days and weeks, by its first day for months.
    periods = (
        days.selectExpr("_day", "_sum", f"{chosen} AS freq")
        .selectExpr(
            "freq",
            "_sum",
            """CASE freq WHEN 'M' THEN trunc(_day, 'MM')
                 WHEN 'W' THEN next_day(date_sub(_day, 1), 'SUN') ELSE _day END AS _start""",
        )
        .groupBy("freq", "_start")
        .agg(F.sum("_sum").alias("_sum"))
    )
    # Each period also emits the empty ones up to its successor.
    filled = (
        periods.selectExpr("*", "lead(_start) OVER (ORDER BY _start) AS _next")
        .selectExpr(
            "freq",
            "_start",
            "_sum",
            """explode(CASE freq
                 WHEN 'M' THEN sequence(_start, coalesce(add_months(_next, -1), _start), interval 1 month)
                 WHEN 'W' THEN sequence(_start, coalesce(date_sub(_next, 7), _start), interval 7 day)
                 ELSE sequence(_start, coalesce(date_sub(_next, 1), _start), interval 1 day) END) AS _at""",
        )
        .selectExpr(
            "freq",
            "CASE freq WHEN 'M' THEN last_day(_at) ELSE _at END AS period",
            "CASE WHEN _at = _start THEN _sum ELSE 0D END AS value",
        )
    )
    return rolling_trend(filled.orderBy(F.desc("period")).limit(last), last)


def rolling_trend(periods: DataFrame, last: int = LAST_PERIODS) -> DataFrame:
    """Adds ``position`` and the trailing mean over ``max(3, rows // 10)`` of at most ``last`` rows."""
    # A frame needs a constant width; the few possible widths share one sort.
    widths = range(MIN_WINDOW, max(MIN_WINDOW, last // 10) + 1)
    frame = "WHEN {w} THEN avg(value) OVER (ORDER BY period ROWS BETWEEN {before} PRECEDING AND CURRENT ROW)"
    means = " ".join(frame.format(w=w, before=w - 1) for w in widths)
    return periods.selectExpr(
        "CAST(row_number() OVER (ORDER BY period) - 1 AS INT) AS position",
        "period",
        "freq",
        "value",
        f"CASE greatest({MIN_WINDOW}, CAST(floor(count(*) OVER () / 10) AS INT)) {means} END AS trend",
    ).select(
        "position",
        date_label(F.col("period")).alias("period"),
        "freq",
        safe_scalar(F.col("value")).alias("value"),
        safe_scalar(F.col("trend")).alias("trend"),
    )


def trend_direction(series: DataFrame) -> DataFrame:
    """``(direction, periods)``: last against first shown value; no row for a single period."""
    first, final = F.min_by("value", "position"), F.max_by("value", "position")
    return (
        series.agg(first.alias("_first"), final.alias("_last"), F.count("*").alias("periods"))
        .where("periods > 1")
        .select(
            F.when(F.col("_last") > F.col("_first"), "upward")
            .when(F.col("_last") < F.col("_first"), "downward")
            .otherwise("flat")
            .alias("direction"),
            "periods",
        )
    )
