"""Resampling against pandas and fixed anchors."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import timeseries as ts


def series(spark, rows, freq=None, **kw):
    df = spark.createDataFrame([(pd.Timestamp(t).to_pydatetime(), v) for t, v in rows], "t timestamp_ntz, v double")
    return ts.resample(df, F.col("t"), F.col("v"), freq, **kw).orderBy("position").collect()


POINTS = [("2024-01-05 10:00", 1.0), ("2024-01-07 15:00", 2.0), ("2024-01-08 00:00", 4.0)]


def test_weeks_end_on_sunday(spark):
    assert [(r.period, r.value) for r in series(spark, POINTS, "W")] == [("2024-01-07", 3.0), ("2024-01-14", 4.0)]


def test_months_are_labelled_by_their_end(spark):
    rows = POINTS + [("2024-01-31 23:00", 8.0), ("2024-03-02", 16.0)]
    got = [(r.period, r.value) for r in series(spark, rows, "M")]
    assert got == [("2024-01-31", 15.0), ("2024-02-29", 0.0), ("2024-03-31", 16.0)]


def test_rolling_mean(spark):
    rows = [(f"2024-01-0{i + 1}", float(i)) for i in range(4)]
    assert [r.trend for r in series(spark, rows)] == [0.0, 0.5, 1.0, 2.0]


def test_rows_without_value_do_not_count(spark):
    rows = [("2024-01-01", 1.0), ("2024-01-09", None), ("2024-01-03", 2.0)]
    assert [(r.period, r.value) for r in series(spark, rows)] == [("2024-01-01", 1.0), ("2024-01-02", 0.0), ("2024-01-03", 2.0)]


@pytest.mark.parametrize("n, freq", [(120, "D"), (121, "W"), (500, "W"), (501, "M")])
def test_adaptive_frequency(spark, n, freq):
    rows = [(pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i), 1.0) for i in range(n)]
    assert {r.freq for r in series(spark, rows)} == {freq}


@pytest.mark.parametrize("freq, rule", [("D", "D"), ("W", "W"), ("M", "ME")])
def test_same_as_pandas(table, freq, rule):
    df = table("orders")
    got = ts.resample(df, F.col("o_orderdate"), F.col("o_totalprice"), freq).orderBy("position").toPandas()
    pdf = df.toPandas().set_index("o_orderdate")["o_totalprice"].resample(rule).sum().tail(60)
    trend = pdf.rolling(max(3, len(pdf) // 10), min_periods=1).mean()
    assert list(got.period) == [str(d)[:10] for d in pdf.index]
    assert got.value.round(2).tolist() == pytest.approx(pdf.round(2).tolist())
    assert got.trend.tolist() == pytest.approx(trend.tolist(), abs=1e-3)


def test_total_is_kept_when_all_periods_are_shown(table):
    df = table("events")
    got = ts.resample(df, F.col("ts"), F.col("value"), "D").agg(F.sum("value")).first()[0]
    assert got == pytest.approx(df.agg(F.sum("value")).first()[0], abs=0.01)


def test_direction(spark):
    def direction(rows):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "position int, value double")
        return [r.direction for r in ts.trend_direction(df).collect()]

    assert direction([1.0, 5.0, 2.0]) == ["upward"]
    assert direction([2.0, 5.0, 1.0]) == ["downward"]
    assert direction([2.0, 2.0]) == ["flat"]
    assert direction([2.0]) == []


def test_one_scan_of_the_table(table):
    df = ts.resample(table("orders"), F.col("o_orderdate"), F.col("o_totalprice"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "o_orderstatus" not in plan
