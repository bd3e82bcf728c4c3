"""Chart-ready series over the whole table.

Axis values drop currency signs and take the leading number of a cell; anything else counts as 0.
Types that only draw the plain series (column, bar, line, area, scatter, sunburst) use
:func:`xy_series`; the others compute the statistic their name stands for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.formatting import cell_text, date_label
from tablewright.functions.parsing import chart_value, column, double_of, is_number_type, present
from tablewright.operators.quantiles import exact_quantiles
from tablewright.operators.rowindex import running_total

# Slices and points a chart shows.
PIE_SLICES = 10
RADIAL_SLICES = 7
RADAR_POINTS = 15
MIN_BUBBLE = 5
TREND_LIFT = 1.1


def axis_label(df: DataFrame, name: str) -> Column:
    return F.coalesce(cell_text(df, name), F.lit(""))


def axis_value(df: DataFrame, name: str) -> Column:
    if is_number_type(df.schema[name].dataType):
        return F.coalesce(double_of(df, name), F.lit(0.0))
    return chart_value(column(name).cast("string"))


def xy_series(df: DataFrame, x: str, y: str, keep: list[str] | None = None) -> DataFrame:
    """``(*keep, label, value)``, one point per row; ``keep`` carries the row order."""
    return df.select(*[column(c) for c in keep or []], axis_label(df, x).alias("label"), axis_value(df, y).alias("value"))


def plottable(df: DataFrame, y: str) -> DataFrame:
    """One row ``(column, plottable)``: false when every axis value is 0."""
    return df.agg(F.coalesce(F.bool_or(axis_value(df, y) != 0), F.lit(False)).alias("plottable")).select(
        F.lit(y).alias("column"), "plottable"
    )


def pie_slices(df: DataFrame, x: str, y: str, tie: list[str], slices: int = PIE_SLICES) -> DataFrame:
    """``(rank, label, value)``: with more than ``slices`` rows the largest by size plus ``Other``.

    The row that would be last becomes ``Other`` and gets the total of everything not shown, so the
    top list is read once; count and total come from one scalar aggregate. Fewer rows stay as they
    are, in the order of ``tie``.
    """
    points = xy_series(df, x, y, tie)
    totals = points.agg(F.struct(F.count("*").alias("n"), F.sum(F.abs("value")).alias("size")).alias("t")).scalar()
    ranked = _top_points(points, F.abs("value"), tie, slices, totals)
    cropped = F.col("_all.n") > slices
    shown = F.sum(F.when(F.col("rank") < slices, F.abs("value"))).over(Window.partitionBy(F.lit(0)))
    is_other = cropped & (F.col("rank") == slices)
    return ranked.withColumn("_shown", shown).select(
        "rank",
        F.when(is_other, F.lit("Other")).otherwise(F.col("label")).alias("label"),
        F.round(
            F.when(is_other, F.col("_all.size") - F.col("_shown"))
            .when(cropped, F.abs("value"))
            .otherwise(F.col("value")),
            4,
        ).alias("value"),
    )


def _top_points(points: DataFrame, size: Column, tie: list[str], k: int, totals: Column) -> DataFrame:
    """The ``k`` largest points, ranked by size if any were left out and else by ``tie``.

    ``totals`` is a scalar struct with the number of points ``n``; it is kept as ``_all``.
    """
    last = [column(t) for t in tie]
    top = points.orderBy(size.desc(), *last).limit(k).withColumn("_all", totals)
    order = [F.when(F.col("_all.n") > k, size).desc(), *last]
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def radar_points(df: DataFrame, x: str, y: str, tie: list[str], points: int = RADAR_POINTS) -> DataFrame:
    """``(rank, label, value)``: the points with the largest values, or all in order if they are few."""
    series = xy_series(df, x, y, tie)
    total = series.agg(F.struct(F.count("*").alias("n")).alias("t")).scalar()
    return _top_points(series, F.col("value"), tie, points, total).select("rank", "label", "value")


def bubble(df: DataFrame, x: str, y: str, keep: list[str] | None = None) -> DataFrame:
    """The series with a bubble size of half the value, at least 5."""
    return xy_series(df, x, y, keep).withColumn(
        "size", F.greatest(F.lit(float(MIN_BUBBLE)), F.abs("value") / 2)
    )


def treemap(df: DataFrame, x: str, y: str, keep: list[str] | None = None) -> DataFrame:
    """The series with absolute values (treemap, heatmap)."""
    return xy_series(df, x, y, keep).withColumn("value", F.abs("value"))


def combo(df: DataFrame, x: str, y: str, keep: list[str] | None = None) -> DataFrame:
    """Bars with a line 10% above them."""
    return xy_series(df, x, y, keep).withColumn("line", F.round(F.col("value") * TREND_LIFT, 4))


def group_totals(df: DataFrame, x: str, y: str) -> DataFrame:
    return (
        df.select(axis_label(df, x).alias("label"), axis_value(df, y).alias("value"))
        .groupBy("label")
        .agg(F.sum("value").alias("value"))
    )


def pareto(df: DataFrame, x: str, y: str) -> DataFrame:
    """``(label, value, running, share)``: group totals, largest first, with the cumulative percent.

    The number of groups has no bound, so the running total is the partitioned one.
    """
    totals = group_totals(df, x, y)
    ordered = running_total(totals, [F.desc("value"), F.col("label")], "value", "running")
    whole = ordered.agg(F.sum("value")).scalar()
    return ordered.select(
        "label",
        F.round("value", 4).alias("value"),
        F.round("running", 4).alias("running"),
        F.round(F.try_divide(F.col("running"), whole) * 100, 4).alias("share"),
    )


def box_plot(df: DataFrame, x: str, y: str, limit: int | None = None) -> DataFrame:
    """``(label, n, low, q1, median, q3, high)`` per group, exact for groups of any size."""
    points = df.select(cell_text(df, x).alias("label"), double_of(df, y).alias("value"))
    found = exact_quantiles(points, F.col("value"), [0, 0.25, 0.5, 0.75, 1], ["label"], limit)
    parts = ["low", "q1", "median", "q3", "high"]
    return found.select(
        "label", "n", *[F.round(F.element_at("quantiles", i + 1), 4).alias(p) for i, p in enumerate(parts)]
    )


def candlestick(df: DataFrame, time: str, y: str, tie: str, freq: str = "D") -> DataFrame:
    """``(period, open, high, low, close)``: first, largest, smallest and last value per period."""
    at = F.struct(column(time), column(tie))
    day = F.to_date(column(time))
    period = {
        "D": day,
        "W": F.next_day(F.date_sub(day, 1), "SUN"),
        "M": F.last_day(day),
    }[freq]
    points = df.select(at.alias("_at"), period.alias("_period"), double_of(df, y).alias("_v")).na.drop(subset=["_period", "_v"])
    return points.groupBy(date_label(F.col("_period")).alias("period")).agg(
        F.min_by("_v", "_at").alias("open"),
        F.max("_v").alias("high"),
        F.min("_v").alias("low"),
        F.max_by("_v", "_at").alias("close"),
    )


def histogram(df: DataFrame, y: str, bins: int = 10) -> DataFrame:
    """``(bin, low, high, n)``: equal-width bins over the whole range; empty bins are kept."""
    values = df.select(double_of(df, y).alias("v")).where("v is not null")
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    spark = df.sparkSession
    if ends["lo"] is None:
        return spark.createDataFrame([], "bin int, low double, high double, n bigint")
    lo, width = ends["lo"], (ends["hi"] - ends["lo"]) / bins
    if width == 0:
        bins, width = 1, 1.0
    place = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).cast("int")
    counted = values.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    return (
        spark.range(bins)
        .select(F.col("id").cast("int").alias("bin"))
        .join(F.broadcast(counted), "bin", "left")  # at most ``bins`` rows
        .select(
            "bin",
            F.round(lo + F.col("bin") * width, 4).alias("low"),
            F.round(lo + (F.col("bin") + 1) * width, 4).alias("high"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def stacked(df: DataFrame, x: str, series: str, y: str) -> DataFrame:
    """``(label, series, value, share)``: sums per group and series, and the percent within the group.

    Group totals are joined rather than computed in a window per group, as a group may have any
    number of series. Both sides read the same shuffled sums.
    """
    sums = (
        df.select(axis_label(df, x).alias("label"), axis_label(df, series).alias("series"), axis_value(df, y).alias("_v"))
        .groupBy("label", "series")
        .agg(F.sum("_v").alias("_sum"))
    )
    totals = sums.groupBy("label").agg(F.sum("_sum").alias("_total"))
    return sums.join(totals, "label").select(
        "label",
        "series",
        F.round("_sum", 4).alias("value"),
        F.round(F.try_divide(F.col("_sum"), F.col("_total")) * 100, 4).alias("share"),
    )


def waterfall(df: DataFrame, x: Column, y: str) -> DataFrame:
    """``(step, value, start, end)``: running bounds over the steps in the order of ``x``."""
    steps = df.select(x.alias("step"), axis_value(df, y).alias("value")).groupBy("step").agg(F.sum("value").alias("value"))
    ended = running_total(steps, ["step"], "value", "end")
    return ended.select(
        "step",
        F.round("value", 4).alias("value"),
        F.round(F.col("end") - F.col("value"), 4).alias("start"),
        F.round("end", 4).alias("end"),
    )


def funnel(df: DataFrame, stage: str, stages: list[str]) -> DataFrame:
    """``(position, stage, n, conversion)`` in the given stage order; percent of the stage before."""
    place = F.array_position(F.array(*[F.lit(s) for s in stages]), column(stage)).cast("int")
    counts = df.where(column(stage).isin(stages)).groupBy(place.alias("position")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.createDataFrame([(i + 1, s) for i, s in enumerate(stages)], "position int, stage string")
    steps = spine.join(F.broadcast(counts), "position", "left").select(  # at most one row per stage
        "position", "stage", F.coalesce("n", F.lit(0)).alias("n")
    )
    before = F.lag("n").over(Window.orderBy("position"))
    return steps.select(
        "position", "stage", "n", F.round(F.try_divide(F.col("n").cast("double"), before) * 100, 4).alias("conversion")
    )


def series_for(df: DataFrame, kind: str, x: str, y: str, tie: list[str], **options) -> DataFrame:
    """The series of a chart kind by its name.

    Options: ``series`` splits stacked charts, ``stages`` orders a funnel, ``freq`` sets the candle
    period, ``bins`` the histogram.
    """
    if kind in ("pie", "donut", "polarArea"):
        return pie_slices(df, x, y, tie)
    if kind == "radialBar":
        return pie_slices(df, x, y, tie, RADIAL_SLICES)
    if kind == "radar":
        return radar_points(df, x, y, tie)
    if kind == "bubble":
        return bubble(df, x, y, tie)
    if kind in ("treemap", "heatmap"):
        return treemap(df, x, y, tie)
    if kind == "combo":
        return combo(df, x, y, tie)
    if kind == "pareto":
        return pareto(df, x, y)
    if kind == "boxPlot":
        return box_plot(df, x, y)
    if kind == "candlestick":
        return candlestick(df, x, y, tie[0], options.get("freq", "D"))
    if kind == "histogram":
        return histogram(df, y, options.get("bins", 10))
    if kind == "waterfall":
        return waterfall(df, axis_label(df, x), y)
    if kind in STACKED_KINDS and "series" in options:
        return stacked(df, x, options["series"], y)
    if kind == "funnel" and "stages" in options:
        return funnel(df, x, options["stages"])
    if kind in PLAIN_KINDS + STACKED_KINDS + ["funnel"]:
        return xy_series(df, x, y, tie)
    raise ValueError(f"unknown chart kind {kind!r}")


# Chart kinds that show the plain series, and those that stack one per column.
PLAIN_KINDS = ["bar", "h-bar", "line", "area", "scatter", "sunburst"]
STACKED_KINDS = ["stacked-col", "stacked-bar", "100-stacked-col", "100-stacked-bar"]
