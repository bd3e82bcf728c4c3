"""Column functions, KPI rows, slices, formulas and exact quantiles."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.operators import aggregates as agg
from tablewright.operators.quantiles import exact_median, exact_quantiles


def test_functions_on_currency_text(spark):
    df = spark.createDataFrame([("$1,000",), ("2",), ("n/a",), ("nan",), (None,), ("4",)], "c string")
    got = {fn: agg.column_function_value(df, fn, "c") for fn in agg.FUNCTIONS}
    v = np.array([1000.0, 2.0, 4.0])
    assert got["SUM"] == 1006 and got["COUNT"] == 3 and got["MEDIAN"] == 4
    assert got["AVG"] == got["AVERAGE"] == round(v.mean(), 4)
    assert got["STDEV"] == round(v.std(), 4) and got["VARIANCE"] == round(v.var(), 4)


def test_function_errors(spark):
    df = spark.createDataFrame([("x",)], "c string")
    with pytest.raises(ValueError, match="supported"):
        agg.column_function(df, "MODE", "c")
    with pytest.raises(ValueError, match="not found"):
        agg.column_function(df, "SUM", "d")
    for fn in ("sum", "count", "median"):
        with pytest.raises(ValueError, match="no numeric"):
            agg.column_function_value(df, fn, "c")


def test_truth_values_are_not_numbers_for_functions(spark):
    df = spark.createDataFrame([(True,), (False,)], "c boolean")
    with pytest.raises(ValueError, match="no numeric"):
        agg.column_function_value(df, "SUM", "c")


def test_quantiles_of_extreme_values(spark):
    v = [1e300, -1e300, 5e-324, 0.0, 1.0, 1e308, -1e308, float("inf"), float("-inf")] * 30 + list(range(100))
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = exact_quantiles(df, F.col("v"), [0.25, 0.5, 0.6], limit=10).first()
    assert got.n == len(v)
    assert np.allclose(got.quantiles, np.quantile(v, [0.25, 0.5, 0.6]))


def test_kpi_of_single_value_has_no_deviation(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    got = {(r.column, r.stat): r.value for r in agg.kpi_block(df, ["a", "b"]).collect()}
    assert got == {("a", "sum"): 1.0, ("a", "mean"): 1.0, ("a", "min"): 1.0, ("a", "max"): 1.0, ("a", "std"): None}


def test_kpi_infinite_sum_is_null(spark):
    df = spark.createDataFrame([(float("inf"),), (1.0,)], "a double")
    got = {r.stat: r.value for r in agg.kpi_block(df, ["a"]).collect()}
    assert got["sum"] is None and got["min"] == 1.0


def test_counts_are_taken_on_text(spark):
    df = spark.createDataFrame([("1",), ("1",), ("1.0",), (None,), ("True",)], "c string")
    got = [(r.label, r.n) for r in agg.value_counts_top(df, "c").orderBy("rank").collect()]
    assert got == [("1", 2), ("1.0", 1), ("True", 1)]


def test_merge_reconciles_with_the_shown_total(spark):
    sizes = [1000, 500, 400, 300, 200, 100, 50, 20, 10, 5, 3]
    df = spark.createDataFrame([(f"g{i}",) for i, n in enumerate(sizes) for _ in range(n)], "c string")
    got = agg.merge_small(agg.value_counts_top(df, "c")).orderBy("rank").collect()
    total = sum(sizes[:10])
    kept = [n for n in sizes[:10] if n >= 0.02 * total]
    assert [r.n for r in got] == kept + [total - sum(kept)]
    assert got[-1].label == "Other"
    shares = agg.share_of_total(agg.merge_small(agg.value_counts_top(df, "c"))).collect()
    assert {r.total for r in shares} == {total}


def test_seven_slices_are_not_merged(spark):
    df = spark.createDataFrame([("big",)] * 1000 + [(f"s{i}",) for i in range(6)], "c string")
    assert "Other" not in [r.label for r in agg.merge_small(agg.value_counts_top(df, "c")).collect()]


def test_group_sum_leaves_out_incomplete_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 5.0), ("b", float("nan")), ("c", 2.0)], "x string, y double")
    got = [(r.rank, r.label, r.value) for r in agg.group_sum_top(df, "x", "y").orderBy("rank").collect()]
    assert got == [(1, "c", 2.0), (2, "a", 1.0)]


@pytest.fixture
def cells(spark):
    return spark.createDataFrame([(0, "10", "x"), (1, "20.5kg", "3"), (2, None, "7")], "row_index int, a string, b string")


@pytest.mark.parametrize(
    "text, result",
    [
        ("=SUM(A1,A2,3)", "33.5"),
        ("=sum( a1 , b2 )", "13"),
        ("=AVERAGE(A1,B1)", "5"),
        ("=COUNT(A1,Z9,x)", "3"),
        ("=MAX(A1,A2)", "20.5"),
        ("=MIN(A1,A3)", "0"),
        ("=MEDIAN(A1,A2,B2,B3)", "8.5"),
        ("=MEDIAN(A1,A2,B2)", "10"),
        ("=STDEV(B2,B3)", "2"),
        ("=VARIANCE(B2,B3)", "4"),
        ("=SUM(1,2)", "3"),
        ("=SUM(A99,B2)", "3"),
        ("=NOPE(A1)", "#NAME?"),
        ("=A1", "#NAME?"),
        ("plain", "plain"),
    ],
)
def test_cell_formula(cells, text, result):
    assert agg.cell_formula(cells, text).collect()[0].result == result


def test_formula_reads_only_addressed_rows(cells, spark, tmp_path):
    cells.write.parquet(str(tmp_path / "cells"))
    plan = agg.cell_formula(spark.read.parquet(str(tmp_path / "cells")), "=SUM(A1,A2)")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(row_index, [0,1])]" in plan
    assert "ReadSchema: struct<row_index:int,a:string>" in plan


def check_quantiles(spark, groups, limit):
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0, 0.1, 0.25, 0.5, 0.75, 0.99, 1]
    got = {r.g: r for r in exact_quantiles(df, F.col("v"), probs, ["g"], limit=limit).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g].n == len(vs)
        assert np.allclose(got[g].quantiles, np.quantile(vs, probs), rtol=1e-12)


def test_quantiles_of_narrowed_and_small_groups(spark):
    rng = np.random.default_rng(7)
    groups = {
        "hot": rng.normal(size=4000),
        "ties": rng.integers(0, 3, size=3000),
        "constant": np.full(900, 4.0),
        "skewed": np.exp(rng.normal(size=1500) * 6),
        "few": [3.0, 1.0],
        "one": [5.0],
    }
    check_quantiles(spark, groups, limit=50)


def test_both_ways_give_the_same_digits(spark):
    rng = np.random.default_rng(17)
    rows = [(g, float(v)) for g in "abc" for v in np.exp(rng.normal(size=700) * 9)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.013, 0.1, 0.25, 1 / 3, 0.5, 0.77, 0.9]
    direct, narrowed = [{r.g: r.quantiles for r in exact_quantiles(df, F.col("v"), probs, ["g"], limit=n).collect()} for n in (None, 20)]
    assert direct == narrowed


def test_quantiles_without_groups(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25)])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    probs = [0, 0.3, 0.5, 0.9, 1]
    got = exact_quantiles(df, F.col("v"), probs, limit=40).first()
    assert np.allclose(got.quantiles, np.quantile(v, probs), rtol=1e-12)
    assert exact_median(df, F.col("v"), limit=40).first().median == pytest.approx(float(np.median(v)), rel=1e-12)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(-3, 3), st.floats(-1e6, 1e6)), min_size=1, max_size=80))
def test_median_of_anything(spark, vs):
    df = spark.createDataFrame([(float(v),) for v in vs], "v double")
    got = exact_median(df, F.col("v"), limit=5).first().median
    assert got == pytest.approx(float(np.median(vs)), rel=1e-12, abs=1e-9)
