"""Plain-text insights, KPI cards and other small views derived from a long dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.formatting import compact_number, ranked_label

# Fixed value: above this percentage of missing cells the table should be cleaned first.
NULL_WARNING = 5


def _facts(dash: DataFrame) -> DataFrame:
    """One row with everything the texts and cards need; one aggregate over a few hundred rows."""

    def pick(what: str, condition: str, name: str) -> str:
        return f"max({what}) FILTER (WHERE {condition}) AS {name}"

    first_kpi = "section = 'kpi' AND position = 0"
    line = "section = 'line' AND NOT endswith(item, ' Trend')"
    facts = [
        pick("value", "section = 'meta' AND item = 'rows'", "rows"),
        pick("value", "section = 'meta' AND item = 'cols'", "cols"),
        pick("value", "section = 'meta' AND item = 'null_pct'", "null_pct"),
        pick("label", "section = 'meta' AND item = 'dimension'", "x"),
        pick("label", "section = 'meta' AND item = 'measure'", "y"),
        pick("item", first_kpi, "kpi"),
        *[pick("value", f"{first_kpi} AND label = '{s}'", f"k_{s}") for s in ("sum", "mean", "min", "max")],
        pick("label", "section = 'pie' AND position = 0", "pie_label"),
        pick("value", "section = 'pie' AND position = 0", "pie_first"),
        "sum(value) FILTER (WHERE section = 'pie') AS pie_total",
        pick("label", "section = 'bar' AND position = 0", "bar_label"),
        pick("value", "section = 'bar' AND position = 0", "bar_first"),
        f"min_by(value, position) FILTER (WHERE {line}) AS line_first",
        f"max_by(value, position) FILTER (WHERE {line}) AS line_last",
        f"count(*) FILTER (WHERE {line}) AS line_n",
    ]
    return dash.selectExpr(*facts)


def _fixed(value: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", value)


def insights(dash: DataFrame) -> DataFrame:
    """``(position, kind, text)``: at most six sentences on size, nulls, peak, top share, top sum, trend."""
    f = F.col
    lift = F.when(
        (f("k_mean") != 0) & (f("k_max") != 0),
        F.concat(
            F.lit(" — "),
            _fixed((f("k_max") - f("k_mean")) / f("k_mean") * 100, 0),
            F.lit("% above average ("),
            compact_number(f("k_mean")),
            F.lit(")"),
        ),
    ).otherwise(F.lit(""))
    share = F.when(
        f("pie_total") != 0,
        F.concat(F.lit(" ("), _fixed(f("pie_first") / f("pie_total") * 100, 1), F.lit("%)")),
    ).otherwise(F.lit(""))
    direction = (
        F.when(f("line_last") > f("line_first"), "upward")
        .when(f("line_last") < f("line_first"), "downward")
        .otherwise("flat")
    )
    nulls = _fixed(f("null_pct"), 1)
    # The sentences.
    texts = [
        (
            "size",
            f("rows").isNotNull(),
            F.concat(
                F.lit("Dataset has "), F.format_number(f("rows"), 0), F.lit(" rows and "),
                f("cols").cast("int").cast("string"), F.lit(" columns."),
            ),
        ),
        (
            "nulls",
            f("null_pct").isNotNull(),
            F.when(
                f("null_pct") > NULL_WARNING, F.concat(nulls, F.lit("% null values — consider cleaning first."))
            ).otherwise(F.concat(F.lit("Great data quality — only "), nulls, F.lit("% nulls."))),
        ),
        (
            "peak",
            f("kpi").isNotNull(),
            F.concat(F.lit('"'), f("kpi"), F.lit('" peaks at '), compact_number(f("k_max")), lift, F.lit(".")),
        ),
        (
            "share",
            f("pie_label").isNotNull(),
            F.concat(F.lit('"'), f("pie_label"), F.lit('" is the top '), f("x"), share, F.lit(".")),
        ),
        (
            "top",
            f("bar_label").isNotNull(),
            F.concat(
                F.lit("Top "), f("x"), F.lit(': "'), f("bar_label"), F.lit('" with '),
                compact_number(f("bar_first")), F.lit(" in "), f("y"), F.lit("."),
            ),
        ),
        (
            "trend",
            f("line_n") > 1,
            F.concat(
                f("y"), F.lit(" shows a "), direction, F.lit(" trend over "),
                f("line_n").cast("string"), F.lit(" periods."),
            ),
        ),
    ]
    entries = [
        F.when(present, F.struct(F.lit(i).alias("position"), F.lit(kind).alias("kind"), text.alias("text")))
        for i, (kind, present, text) in enumerate(texts)
    ]
    return _facts(dash).select(F.inline(F.array_compact(F.array(*entries))))


def kpi_cards(dash: DataFrame) -> DataFrame:
    """``(position, label, value, sub, note, trend_up)``: records, then sum, mean and peak of the first KPI."""
    f = F.col
    # The labels of the cards.
    cards = [
        (F.lit("Total Records"), f("rows"), "Dataset Size", F.concat(f("cols").cast("int").cast("string"), F.lit(" columns")), F.lit(True)),
        (f("kpi"), f("k_sum"), "Total SUM", F.concat(F.lit("Avg "), compact_number(f("k_mean"))), F.lit(True)),
        (f("kpi"), f("k_mean"), "Average", F.concat(F.lit("Max "), compact_number(f("k_max"))), f("k_max") > f("k_mean")),
        (f("kpi"), f("k_max"), "Peak Value", F.concat(F.lit("Min "), compact_number(f("k_min"))), F.lit(True)),
    ]
    entries = [
        F.when(
            label.isNotNull(),
            F.struct(
                F.lit(i).alias("position"),
                label.alias("label"),
                value.alias("value"),
                F.lit(sub).alias("sub"),
                note.alias("note"),
                up.alias("trend_up"),
            ),
        )
        for i, (label, value, sub, note, up) in enumerate(cards)
    ]
    return _facts(dash).select(F.inline(F.array_compact(F.array(*entries))))


def ranked_bars(dash: DataFrame) -> DataFrame:
    """``(rank, label, value)``: first shown column of each top row, cut to 22 characters, with its first KPI."""

    def named(item: str) -> Column:
        meta = (F.col("section") == "meta") & (F.col("item") == item)
        return F.max(F.when(meta, F.col("label"))).over(Window.partitionBy(F.lit(0)))

    # The window runs over the few rows of the dashboard.
    tagged = dash.where("section in ('meta', 'top')").withColumns({"_x": named("dimension"), "_y": named("measure")})
    whole = F.col("value") == F.floor("value")
    number = F.when(whole, F.col("value").cast("decimal(38,0)").cast("string")).otherwise(F.col("value").cast("string"))
    text = F.coalesce("label", number)
    return (
        tagged.where("section = 'top'")
        .groupBy((F.col("position") + 1).alias("rank"))
        .agg(
            F.max(F.when(F.col("item") == F.coalesce("_x", "_y"), text)).alias("_label"),
            F.max(F.when(F.col("item") == F.col("_y"), F.col("value"))).alias("_value"),
        )
        .select(
            "rank",
            ranked_label(F.col("_label"), F.col("rank")).alias("label"),
            F.coalesce("_value", F.lit(0.0)).alias("value"),
        )
    )


def type_pills(dash: DataFrame) -> DataFrame:
    """``(position, pill)``: columns per role and the share of missing cells."""
    def of(role: str) -> Column:
        return F.count_if((F.col("section") == "meta") & (F.col("item") == f"{role}_cols"))

    pct = F.max(F.when((F.col("section") == "meta") & (F.col("item") == "null_pct"), F.col("value")))
    counted = dash.agg(
        of("numeric").alias("n"), of("categorical").alias("c"), of("date").alias("d"), pct.alias("p")
    )
    pills = [
        F.concat(F.col("n").cast("string"), F.lit(" Numeric")),
        F.concat(F.col("c").cast("string"), F.lit(" Category")),
        F.when(F.col("d") > 0, F.concat(F.col("d").cast("string"), F.lit(" Date"))).otherwise(F.lit("No Date")),
        F.concat(_fixed(F.col("p"), 1), F.lit("% Null")),
    ]
    return counted.select(F.posexplode(F.array(*pills)).alias("position", "pill"))


def payload(dash: DataFrame) -> DataFrame:
    """One row ``(payload)``: the dashboard as one JSON document with a list of entries per section.

    The input has a few hundred rows at most, whatever the size of the table behind it.
    """
    entry = F.struct("item", "position", "label", "value")
    sections = ["meta", "kpi", "bar", "line", "pie", "top"]
    lists = [
        F.array_sort(F.collect_list(F.when(F.col("section") == s, entry))).alias(s) for s in sections
    ]
    return dash.agg(*lists).select(F.to_json(F.struct(*sections), {"ignoreNullFields": "false"}).alias("payload"))
