"""Resampling and trend queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import timeseries as ts
from workload.registry import query


def resample_sql(source: str, time: str, value: str, freq: str, last: int = 60) -> str:
    """Sums per period, a spine without gaps, the last periods, and the trailing mean."""
    start = {
        "D": f"CAST({time} AS DATE)",
        "W": f"CAST({time} AS DATE) + CAST((7 - isodow({time})) AS INTEGER)",
        "M": f"CAST(date_trunc('month', {time}) AS DATE)",
    }[freq]
    step = {"D": "1 DAY", "W": "7 DAY", "M": "1 MONTH"}[freq]
    period = "last_day(CAST(a.spot AS DATE))" if freq == "M" else "CAST(a.spot AS DATE)"
    return f"""WITH buckets AS (SELECT {start} AS b, sum(CAST({value} AS DOUBLE)) AS s FROM {source}
        WHERE {time} IS NOT NULL AND {value} IS NOT NULL GROUP BY 1),
      spine AS (SELECT unnest(generate_series((SELECT min(b) FROM buckets), (SELECT max(b) FROM buckets), INTERVAL {step})) AS spot),
      shown AS (SELECT spot, coalesce(s, 0) AS v FROM spine LEFT JOIN buckets ON CAST(spot AS DATE) = b ORDER BY spot DESC LIMIT {last}),
      wide AS (SELECT *, row_number() OVER (ORDER BY spot) AS r, count(*) OVER () AS k FROM shown)
    SELECT CAST(a.r - 1 AS INTEGER) AS position, strftime({period}, '%Y-%m-%d') AS period, '{freq}' AS freq,
      round(any_value(a.v), 4) AS value, round(avg(p.v), 4) AS trend
    FROM wide a JOIN wide p ON p.r <= a.r AND p.r > a.r - greatest(3, a.k // 10)
    GROUP BY a.r, a.spot"""


@query("resample_daily", resample_sql("events", "ts", "value", "D"))
def _(t):
    return ts.resample(t("events"), F.col("ts"), F.col("value"), "D")


@query("resample_weekly", resample_sql("events", "ts", "value", "W"))
def _(t):
    return ts.resample(t("events"), F.col("ts"), F.col("value"), "W")


@query("resample_weekly_long", resample_sql("lineitem", "l_shipdate", "l_quantity", "W"))
def _(t):
    return ts.resample(t("lineitem"), F.col("l_shipdate"), F.col("l_quantity"), "W")


@query("resample_monthly", resample_sql("orders", "o_orderdate", "o_totalprice", "M"))
def _(t):
    return ts.resample(t("orders"), F.col("o_orderdate"), F.col("o_totalprice"), "M")


@query("resample_adaptive_monthly", resample_sql("lineitem", "l_shipdate", "l_extendedprice", "M"))
def _(t):
    return ts.resample(t("lineitem"), F.col("l_shipdate"), F.col("l_extendedprice"))


# A few hundred weekly and under 120 monthly totals: the other two adaptive branches, the last one
# with many empty days to fill.
WEEKLY_TOTALS = "(SELECT date_trunc('week', o_orderdate) AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1)"
MONTHLY_TOTALS = "(SELECT date_trunc('month', o_orderdate) AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1)"


def _totals(t, unit: str):
    return (
        t("orders")
        .groupBy(F.to_date(F.date_trunc(unit, "o_orderdate")).alias("d"))
        .agg(F.sum("o_totalprice").alias("v"))
    )


@query("resample_adaptive_weekly", resample_sql(WEEKLY_TOTALS, "d", "v", "W"))
def _(t):
    return ts.resample(_totals(t, "week"), F.col("d"), F.col("v"))


@query("resample_adaptive_daily_gaps", resample_sql(MONTHLY_TOTALS, "d", "v", "D"))
def _(t):
    return ts.resample(_totals(t, "month"), F.col("d"), F.col("v"))


@query(
    "trend_direction",
    f"""WITH s AS ({resample_sql('orders', 'o_orderdate', 'o_totalprice', 'M')})
    SELECT CASE WHEN arg_max(value, position) > arg_min(value, position) THEN 'upward'
      WHEN arg_max(value, position) < arg_min(value, position) THEN 'downward' ELSE 'flat' END AS direction,
      count(*) AS periods FROM s""",
)
def _(t):
    return ts.trend_direction(ts.resample(t("orders"), F.col("o_orderdate"), F.col("o_totalprice")))
