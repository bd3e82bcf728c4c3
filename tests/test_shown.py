"""Charts, dashboards, insights and recipes."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import charts
from tablewright.plans import insights as views
from tablewright.plans.dashboard import dashboard
from tablewright.plans.recipe import run_recipe


@pytest.fixture
def points(spark):
    rows = [(i, f"l{i}", v) for i, v in enumerate(["5", "$1,000", "x", "-20", "7kg", None])]
    return spark.createDataFrame(rows, "row_index int, x string, y string")


def test_axis_values(points):
    got = [r.value for r in charts.xy_series(points, "x", "y", ["row_index"]).orderBy("row_index").collect()]
    assert got == [5.0, 1000.0, 0.0, -20.0, 7.0, 0.0]
    assert charts.plottable(points, "y").first().plottable is True
    assert charts.plottable(points, "x").first().plottable is False


def test_pie_shows_all_when_few(points):
    got = [(r.label, r.value) for r in charts.pie_slices(points, "x", "y", ["row_index"]).orderBy("rank").collect()]
    assert got == [("l0", 5.0), ("l1", 1000.0), ("l2", 0.0), ("l3", -20.0), ("l4", 7.0), ("l5", 0.0)]
    assert [r.label for r in charts.radar_points(points, "x", "y", ["row_index"]).orderBy("rank").collect()] == [f"l{i}" for i in range(6)]


def test_pie_other_reconciles(spark):
    df = spark.range(100).select("id", F.col("id").cast("string").alias("x"), (F.col("id") - 50).alias("y"))
    got = charts.pie_slices(df, "x", "y", ["id"]).orderBy("rank").collect()
    assert len(got) == 10 and got[-1].label == "Other"
    assert sum(r.value for r in got) == sum(abs(i - 50) for i in range(100))


def test_bubble_treemap_combo(points):
    assert [r.size for r in charts.bubble(points, "x", "y", ["row_index"]).orderBy("row_index").collect()] == [5.0, 500.0, 5.0, 10.0, 5.0, 5.0]
    assert min(r.value for r in charts.treemap(points, "x", "y").collect()) == 0.0
    assert [r.line for r in charts.combo(points, "x", "y", ["row_index"]).orderBy("row_index").collect()][1] == 1100.0


def test_histogram_bounds(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    got = charts.histogram(df, "v", 4).orderBy("bin").collect()
    assert [r.n for r in got] == [25, 25, 25, 26]
    assert (got[0].low, got[-1].high) == (0.0, 100.0)
    constant = spark.createDataFrame([(3.0,)] * 5, "v double")
    assert [r.n for r in charts.histogram(constant, "v").collect()] == [5]
    assert charts.histogram(constant.limit(0), "v").collect() == []


def test_candles(spark):
    rows = [(pd.Timestamp(t).to_pydatetime(), i, v) for i, (t, v) in enumerate(
        [("2024-01-01 09:00", 5.0), ("2024-01-01 10:00", 9.0), ("2024-01-01 11:00", 2.0), ("2024-01-02 09:00", 4.0)])]
    df = spark.createDataFrame(rows, "t timestamp_ntz, i int, v double")
    got = [tuple(r) for r in charts.candlestick(df, "t", "v", "i").orderBy("period").collect()]
    assert got == [("2024-01-01", 5.0, 9.0, 2.0, 2.0), ("2024-01-02", 4.0, 4.0, 4.0, 4.0)]
    assert charts.candlestick(df, "t", "v", "i", "M").first()[0] == "2024-01-31"


def test_box_plot_narrowed_is_the_same(table):
    df = table("lineitem")
    plain = sorted(charts.box_plot(df, "l_returnflag", "l_quantity").collect())
    assert sorted(charts.box_plot(df, "l_returnflag", "l_quantity", limit=100).collect()) == plain


def test_funnel_and_stacked(spark):
    df = spark.createDataFrame([("a", "u", 1.0)] * 4 + [("b", "u", 1.0)] * 2 + [("b", "v", 6.0)], "s string, k string, y double")
    got = [tuple(r) for r in charts.funnel(df, "s", ["a", "b", "c"]).orderBy("position").collect()]
    assert got == [(1, "a", 4, None), (2, "b", 3, 75.0), (3, "c", 0, 0.0)]
    shares = {(r.label, r.series): r.share for r in charts.stacked(df, "s", "k", "y").collect()}
    assert shares == {("a", "u"): 100.0, ("b", "u"): 25.0, ("b", "v"): 75.0}


KINDS = "bar h-bar line pie donut area stacked-col stacked-bar 100-stacked-col 100-stacked-bar scatter bubble histogram boxPlot pareto waterfall funnel treemap sunburst radar radialBar polarArea heatmap combo"


@pytest.mark.parametrize("kind", KINDS.split())
def test_every_chart_kind(points, kind):
    assert charts.series_for(points, kind, "x", "y", ["row_index"]).count() > 0


def test_unknown_chart_kind(points):
    with pytest.raises(ValueError):
        charts.series_for(points, "hologram", "x", "y", ["row_index"])


def test_every_named_kpi_column_is_shown(spark):
    from tablewright.operators.aggregates import kpi_block

    df = spark.createDataFrame([(1, 2.0, 3, 4.0)], "a int, b double, c int, d double")
    assert {r.column for r in kpi_block(df, ["a", "b", "c", "d"]).collect()} == {"a", "b", "c", "d"}


def test_shared_scan_gives_the_same_dashboard(table, monkeypatch):
    import tablewright.plans.dashboard as plan

    df = table("orders")
    shared = sorted(map(str, dashboard(df, "o", measure="o_totalprice", order_by=["o_orderkey"]).collect()))
    monkeypatch.setattr(plan, "SHARED_ROWS", 0)
    apart = sorted(map(str, dashboard(df, "o", measure="o_totalprice", order_by=["o_orderkey"]).collect()))
    assert shared == apart


def test_shared_scan_treats_nan_and_infinities_the_same(spark, monkeypatch):
    import tablewright.plans.dashboard as plan

    values = {3: float("inf"), 7: float("-inf"), 10: float("nan")}
    rows = [(i, f"g{i % 2}", f"2024-01-{i % 4 + 1:02d}", values.get(i, float(i))) for i in range(32)]
    df = spark.createDataFrame(rows, "id int, region string, day string, amount double")
    shared = sorted(map(str, dashboard(df, "o", measure="amount", dimension="region", order_by=["id"]).collect()))
    monkeypatch.setattr(plan, "SHARED_ROWS", 0)
    apart = sorted(map(str, dashboard(df, "o", measure="amount", dimension="region", order_by=["id"]).collect()))
    assert shared == apart
    assert any("section='bar'" in row and "value=None" in row for row in shared)


def test_dashboard_of_messy_text(spark):
    rows = [(f"{i}", "north" if i % 3 else "south", f"2024-01-{i % 28 + 1:02d}" if i % 10 else "?") for i in range(100)]
    df = spark.createDataFrame(rows, "amount string, region string, day string")
    got = dashboard(df, "sales").collect()
    meta = {r.item: r for r in got if r.section == "meta"}
    assert meta["time"].label == "day" and meta["dimension"].label == "region" and meta["measure"].label == "amount"
    assert meta["null_pct"].value == 3.33
    line = [r for r in got if r.section == "line" and r.item == "amount"]
    assert sum(r.value for r in line) == sum(i for i in range(100) if i % 10)


def test_missing_roles_leave_sections_out(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "c string")
    assert {r.section for r in dashboard(df).collect()} == {"meta", "pie"}
    df = spark.createDataFrame([(1,), (2,)], "v int")
    assert {r.section for r in dashboard(df).collect()} == {"meta", "kpi", "top"}
    with pytest.raises(ValueError, match="empty"):
        dashboard(df.limit(0))


def test_nested_columns_are_skipped(spark):
    df = spark.createDataFrame([([1], 1.0), ([2], 2.0)], "a array<int>, v double")
    assert {r.section for r in dashboard(df).collect()} == {"meta", "kpi", "top"}


def test_insights_warn_about_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), (None, None), ("b", None)], "c string, v double")
    texts = {r.kind: r.text for r in views.insights(dashboard(df)).collect()}
    assert texts["size"] == "Dataset has 3 rows and 2 columns."
    assert texts["nulls"] == "50.0% null values — consider cleaning first."
    assert texts["peak"] == '"v" peaks at 1 — 0% above average (1).'
    assert "trend" not in texts


def test_payload_is_json(table):
    board = dashboard(table("orders"), "orders", measure="o_totalprice", order_by=["o_orderkey"])
    doc = json.loads(views.payload(board).first().payload)
    assert set(doc) == {"meta", "kpi", "bar", "line", "pie", "top"}
    assert [e["label"] for e in doc["pie"]] == [e["label"] for e in sorted(doc["pie"], key=lambda e: e["position"])]


def test_recipe(spark):
    df = spark.createDataFrame([(0, " b ", "2"), (1, "a", ""), (2, "a", "")], "row_index bigint, x string, y string")
    got = run_recipe(
        df,
        [
            {"action": "trim"},
            {"action": "fill_empty"},
            {"action": "remove_duplicates"},
            {"action": "expr", "columns": {"z": "concat(x, y)"}},
            {"action": "add_column", "column_name": "n", "default_value": "-"},
            {"action": "search", "text": "A"},
            {"action": "uppercase_columns"},
        ],
    ).collect()
    assert [tuple(r) for r in got] == [(1, "a", "0", "a0", "-")]
    with pytest.raises(ValueError, match="unknown actions"):
        run_recipe(df, [{"action": "launch"}])


def test_recipe_rows_functions_and_charts(spark):
    df = spark.createDataFrame([(0, "b", "2"), (1, "a", "4")], "row_index bigint, x string, y string")
    more = run_recipe(
        df,
        [
            {"action": "add_row", "data": {"x": "c", "y": "9"}},
            {"action": "update_cell", "row_index": 0, "column": "y", "value": "5"},
            {"action": "delete_row", "row_index": 1},
            {"action": "function", "function": "SUM", "column": "y", "result_column": "total"},
            {"action": "sort", "colName": "y", "ascending": False},
        ],
    )
    assert [tuple(r) for r in more.collect()] == [(1, "c", "9", "14.0"), (0, "b", "5", "")]
    assert run_recipe(df, [{"action": "function", "function": "avg", "column": "y"}]).first().result == 3.0
    pie = run_recipe(df, [{"action": "chart", "chartType": "pie", "xCol": 0, "yCol": 1}])
    assert [r.label for r in pie.orderBy("rank").collect()] == ["b", "a"]


def test_group_sums_match_known_values(spark):
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    board = dashboard(orders, "orders", measure="o_totalprice", order_by=["o_orderkey"]).collect()
    bars = {r.label: r.value for r in board if r.section == "bar"}
    assert bars == pytest.approx({"F": 1233170551.74, "O": 1251869314.00, "P": 1273399754.32}, abs=0.01)
    line = sorted((r.position, r.label, r.value) for r in board if r.section == "line" and r.item == "o_totalprice")
    assert len(line) == 60
    assert line[0][1:] == ("1996-09-30", pytest.approx(51746218.56, abs=0.01))
    assert line[-1][1:] == ("2001-08-31", pytest.approx(702947.99, abs=0.01))
    trend = {r.position: r.value for r in board if r.section == "line" and r.item == "o_totalprice Trend"}
    assert trend[59] == pytest.approx(39670289.435, abs=0.01)


def test_odd_column_names(spark):
    rows = [("x", float(i), f"2024-01-{i + 1:02d}") for i in range(9)]
    df = spark.createDataFrame(rows, ["it's a.b", "c\\d `e`", "day"])
    got = dashboard(df, "it's").collect()
    assert {r.section for r in got} == {"meta", "kpi", "bar", "line", "pie", "top"}
    assert {r.item for r in got if r.section == "pie"} == {"it's a.b"}
    assert {r.item for r in got if r.section == "line"} == {"c\\d `e`", "c\\d `e` Trend"}
    assert {r.item for r in got if r.section == "top"} == {"it's a.b", "c\\d `e`"}


def test_clean_dashboard_reads_only_used_columns(table):
    df = table("lineitem")
    board = dashboard(df, measure="l_quantity", order_by=["l_orderkey", "l_linenumber"])
    plan = board._jdf.queryExecution().executedPlan().toString()
    assert "l_suppkey" not in plan and "l_tax" not in plan
    # Key figures and top rows; bars, pie and trend come from the shared table.
    assert plan.count("FileScan parquet") == 2


def test_ranked_bars_without_categories(spark):
    board = dashboard(spark.createDataFrame([(1.0, 2), (5.5, 3)], "v double, w int"))
    assert [tuple(r) for r in views.ranked_bars(board).orderBy("rank").collect()] == [(1, "5.5", 5.5), (2, "1", 1.0)]


def test_recipe_numbers_rows_anew_before_places_count(spark):
    from tablewright.plans.recipe import run_recipe

    df = spark.createDataFrame([(i, i % 3, f"n{i}") for i in range(12)], "row_index bigint, k int, s string")
    keep = {"action": "keep", "condition": "k <> 0"}
    assert sorted(r.row_index for r in run_recipe(df, [keep]).collect()) == [1, 2, 4, 5, 7, 8, 10, 11]
    got = run_recipe(df, [keep, {"action": "delete_row", "row_index": 1}, {"action": "update_cell", "row_index": 0, "column": "s", "value": "first"}])
    assert sorted((r.row_index, r.s) for r in got.collect()) == list(enumerate(["first", "n4", "n5", "n7", "n8", "n10", "n11"]))


def test_written_scalar_keeps_the_type(spark):
    from tablewright.operators import columns

    df = spark.createDataFrame([(0, 1.5, "a"), (1, 2.5, "b")], "row_index bigint, v double, s string")
    got = columns.write_scalar(df, 7, "v")
    assert dict(got.dtypes)["v"] == "double" and [r.v for r in got.orderBy("row_index").collect()] == [1.5, 7.0]
    assert [r.s for r in columns.write_scalar(df, 7, "s").orderBy("row_index").collect()] == ["a", "7"]
    import pytest

    with pytest.raises(ValueError, match="no value of column 'v'"):
        columns.write_scalar(df, "lots", "v")
