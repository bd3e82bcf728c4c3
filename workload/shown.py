"""Chart and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import charts, ordering
from tablewright.plans import insights as views
from tablewright.plans.dashboard import dashboard
from workload.derived import messy_prices, messy_prices_sql
from workload.registry import query
from workload.series import resample_sql
from workload.tables import ORDERS, orders

from workload.values import bar_sql, counts_sql, kpi_sql, merged_sql

CHART_VALUE = (
    "coalesce(TRY_CAST(nullif(regexp_extract(replace(replace({c}, '$', ''), ',', ''), "
    "'^\\s*([+-]?(Infinity|(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?))', 1), '') AS DOUBLE), 0)"
)


@query(
    "chart_xy",
    f"SELECT o_orderkey, o_orderstatus AS label, {CHART_VALUE.format(c='price_txt')} AS value FROM {messy_prices_sql()}",
)
def _(t):
    return charts.xy_series(messy_prices(t("orders")), "o_orderstatus", "price_txt", ["o_orderkey"])


@query("chart_plottable", "SELECT 'p_brand' AS \"column\", FALSE AS plottable UNION ALL SELECT 'p_retailprice', bool_or(p_retailprice <> 0) FROM part")
def _(t):
    return charts.plottable(t("part"), "p_brand").union(charts.plottable(t("part"), "p_retailprice"))


def _pie_sql(slices: int) -> str:
    return f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY abs(p_retailprice) DESC, p_partkey) AS rank FROM part)
    SELECT CAST(rank AS INTEGER) AS rank, p_name AS label, round(abs(p_retailprice), 4) AS value FROM r WHERE rank < {slices}
    UNION ALL SELECT {slices}, 'Other', round(sum(abs(p_retailprice)), 4) FROM r WHERE rank >= {slices}"""


@query("chart_pie", _pie_sql(10))
def _(t):
    return charts.pie_slices(t("part"), "p_name", "p_retailprice", ["p_partkey"])


@query("chart_radial_bar", _pie_sql(7))
def _(t):
    return charts.series_for(t("part"), "radialBar", "p_name", "p_retailprice", ["p_partkey"])


@query(
    "chart_radar",
    """SELECT CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS rank, p_name AS label,
      p_retailprice AS value FROM part QUALIFY rank <= 15""",
)
def _(t):
    return charts.radar_points(t("part"), "p_name", "p_retailprice", ["p_partkey"])


@query(
    "chart_downsampled",
    f"""SELECT row_index, o_orderstatus AS label, o_totalprice AS value FROM {ORDERS}
    WHERE row_index % CAST(ceil((SELECT count(*) FROM orders) / 100.0) AS BIGINT) = 0""",
)
def _(t):
    return charts.xy_series(ordering.stride(orders(t)), "o_orderstatus", "o_totalprice", ["row_index"])


@query(
    "chart_bubble",
    "SELECT s_suppkey, s_name AS label, s_acctbal AS value, greatest(5, abs(s_acctbal) / 2) AS size FROM supplier",
)
def _(t):
    return charts.bubble(t("supplier"), "s_name", "s_acctbal", ["s_suppkey"])


@query("chart_treemap", "SELECT s_suppkey, s_name AS label, abs(s_acctbal) AS value FROM supplier")
def _(t):
    return charts.treemap(t("supplier"), "s_name", "s_acctbal", ["s_suppkey"])


@query("chart_combo", "SELECT s_suppkey, s_name AS label, s_acctbal AS value, round(s_acctbal * 1.1, 4) AS line FROM supplier")
def _(t):
    return charts.combo(t("supplier"), "s_name", "s_acctbal", ["s_suppkey"])


@query(
    "chart_pareto",
    """SELECT label, round(value, 4) AS value, round(sum(value) OVER w, 4) AS running,
      round(sum(value) OVER w / sum(value) OVER () * 100, 4) AS share
    FROM (SELECT CAST(o_custkey AS VARCHAR) AS label, sum(o_totalprice) AS value FROM orders GROUP BY 1)
    WINDOW w AS (ORDER BY value DESC, label ROWS UNBOUNDED PRECEDING)""",
)
def _(t):
    return charts.pareto(t("orders"), "o_custkey", "o_totalprice")


@query(
    "chart_box_plot",
    """SELECT l_returnflag AS label, count(*) AS n, round(min(l_extendedprice), 4) AS low,
      round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(median(l_extendedprice), 4) AS median,
      round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, round(max(l_extendedprice), 4) AS high FROM lineitem GROUP BY 1""",
)
def _(t):
    return charts.box_plot(t("lineitem"), "l_returnflag", "l_extendedprice")


@query(
    "chart_candlestick",
    """SELECT strftime(ts, '%Y-%m-%d') AS period, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
      arg_max(value, (ts, event_id)) AS "close" FROM events GROUP BY 1""",
)
def _(t):
    return charts.candlestick(t("events"), "ts", "value", "event_id")


@query(
    "chart_histogram",
    """WITH e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS w FROM lineitem),
      c AS (SELECT CAST(least(floor((l_extendedprice - lo) / w), 19) AS INTEGER) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1),
      s AS (SELECT CAST(unnest(range(20)) AS INTEGER) AS bin)
    SELECT s.bin AS bin, round(lo + s.bin * w, 4) AS low, round(lo + (s.bin + 1) * w, 4) AS high, coalesce(n, 0) AS n
    FROM s LEFT JOIN c ON s.bin = c.bin, e""",
)
def _(t):
    return charts.histogram(t("lineitem"), "l_extendedprice", 20)


@query(
    "chart_stacked",
    """SELECT l_returnflag AS label, l_linestatus AS series, round(sum(l_quantity), 4) AS value,
      round(sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_returnflag) * 100, 4) AS share FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    return charts.stacked(t("lineitem"), "l_returnflag", "l_linestatus", "l_quantity")


@query(
    "chart_waterfall",
    """SELECT step, round(value, 4) AS value, round(sum(value) OVER w - value, 4) AS start, round(sum(value) OVER w, 4) AS "end"
    FROM (SELECT strftime(o_orderdate, '%Y-%m') AS step, sum(o_totalprice) AS value FROM orders GROUP BY 1)
    WINDOW w AS (ORDER BY step ROWS UNBOUNDED PRECEDING)""",
)
def _(t):
    return charts.waterfall(t("orders"), F.date_format("o_orderdate", "yyyy-MM"), "o_totalprice")


@query(
    "chart_funnel",
    """WITH s AS (SELECT * FROM (VALUES (1, 'view'), (2, 'click'), (3, 'purchase'), (4, 'refund')) v(position, stage)),
      c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
      f AS (SELECT position, stage, coalesce(n, 0) AS n FROM s LEFT JOIN c ON stage = event_type)
    SELECT *, round(n / nullif(lag(n) OVER (ORDER BY position), 0) * 100, 4) AS conversion FROM f""",
)
def _(t):
    return charts.funnel(t("events"), "event_type", ["view", "click", "purchase", "refund"])


# -- dashboards ---------------------------------------------------------------------------------------


def dashboard_sql(table: str, cols: int, roles: dict[str, list[str]], x: str, y: str, d: str, key: str) -> str:
    """Every section in SQL; the roles are those the profile queries check."""

    def row(item, position, label, value):
        text = f"'{label}'" if label else "CAST(NULL AS VARCHAR)"
        return f"SELECT 'meta' AS section, '{item}' AS item, {position} AS position, {text} AS label, CAST({value} AS DOUBLE) AS value"

    meta = [
        row("name", 0, table, "NULL"),
        row("rows", 0, None, f"(SELECT count(*) FROM {table})"),
        row("cols", 0, None, cols),
        row("null_pct", 0, None, 0),
        row("dimension", 0, x, "NULL"),
        row("measure", 0, y, "NULL"),
        row("time", 0, d, "NULL"),
    ]
    meta += [row(f"{role}_cols", i, c, "NULL") for role, cs in roles.items() for i, c in enumerate(cs)]
    numbers = [y] + [c for c in roles["numeric"] if c != y]
    shown = roles["categorical"][:2]
    line = resample_sql(table, d, y, "M")
    top = []
    for c in shown:
        top.append(f"SELECT 'top', '{c}', r - 1, {c}, CAST(NULL AS DOUBLE) FROM t")
    for c in numbers[:3]:
        top.append(f"SELECT 'top', '{c}', r - 1, CAST(NULL AS VARCHAR), round(CAST({c} AS DOUBLE), 4) FROM t")
    top_rows = f"(SELECT *, CAST(row_number() OVER (ORDER BY {y} DESC, {key}) AS INTEGER) AS r FROM {table} QUALIFY r <= 5)"
    return " UNION ALL ".join(
        meta
        + [
            f'SELECT \'kpi\', "column", position, stat, value FROM ({kpi_sql(table, numbers[:3])})',
            f"SELECT 'bar', '{x}', rank - 1, label, value FROM ({bar_sql(table, x, y)})",
            f"SELECT 'line', '{y}', position, period, value FROM ({line})",
            f"SELECT 'line', '{y} Trend', position, period, trend FROM ({line})",
            f"SELECT 'pie', '{x}', rank - 1, label, CAST(n AS DOUBLE) FROM ({merged_sql(counts_sql(table, x))})",
        ]
        + [part.replace("FROM t", f"FROM {top_rows}") for part in top]
    )


ORDER_ROLES = {
    "numeric": ["o_orderkey", "o_custkey", "o_totalprice"],
    "categorical": ["o_orderstatus", "o_orderpriority"],
    "date": ["o_orderdate"],
}
EVENT_ROLES = {"numeric": ["event_id", "user_id", "value"], "categorical": ["event_type", "props"], "date": ["ts"]}
ORDER_BOARD = dashboard_sql("orders", 6, ORDER_ROLES, "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderkey")


def order_board(t):
    return dashboard(t("orders"), "orders", measure="o_totalprice", order_by=["o_orderkey"])


@query("dashboard_orders", ORDER_BOARD)
def _(t):
    return order_board(t)


@query(
    "dashboard_orders_by_default_roles",
    dashboard_sql("orders", 6, ORDER_ROLES, "o_orderstatus", "o_orderkey", "o_orderdate", "o_orderkey"),
)
def _(t):
    return dashboard(t("orders"), "orders", order_by=["o_orderkey"])


@query("dashboard_events", dashboard_sql("events", 6, EVENT_ROLES, "event_type", "value", "ts", "event_id"))
def _(t):
    return dashboard(t("events"), "events", measure="value", order_by=["event_id"])


@query("dashboard_meta", f"SELECT * FROM ({ORDER_BOARD}) WHERE section = 'meta'")
def _(t):
    return order_board(t).where("section = 'meta'")


def _fact(where: str, what: str = "value") -> str:
    return f"(SELECT max({what}) FROM d WHERE {where})"


@query(
    "insights",
    f"""WITH d AS ({ORDER_BOARD}),
      f AS (SELECT {_fact("section = 'meta' AND item = 'rows'")} AS n,
        {_fact("section = 'kpi' AND item = 'o_totalprice' AND label = 'max'")} AS mx,
        {_fact("section = 'kpi' AND item = 'o_totalprice' AND label = 'mean'")} AS mean,
        {_fact("section = 'pie' AND position = 0", 'label')} AS pl, {_fact("section = 'pie' AND position = 0")} AS pv,
        (SELECT sum(value) FROM d WHERE section = 'pie') AS pt,
        {_fact("section = 'bar' AND position = 0", 'label')} AS bl, {_fact("section = 'bar' AND position = 0")} AS bv,
        {_fact("item = 'o_totalprice' AND section = 'line' AND position = 0")} AS l0,
        (SELECT arg_max(value, position) FROM d WHERE section = 'line' AND item = 'o_totalprice') AS l1,
        (SELECT count(*) FROM d WHERE section = 'line' AND item = 'o_totalprice') AS ln)
    SELECT 0 AS position, 'size' AS kind, format('Dataset has {{:,}} rows and 6 columns.', CAST(n AS BIGINT)) AS text FROM f
    UNION ALL SELECT 1, 'nulls', 'Great data quality — only 0.0% nulls.' FROM f
    UNION ALL SELECT 2, 'peak', format('"o_totalprice" peaks at {{:.2f}}K — {{:.0f}}% above average ({{:.2f}}K).', mx / 1000, (mx - mean) / mean * 100, mean / 1000) FROM f
    UNION ALL SELECT 3, 'share', format('"{{}}" is the top o_orderstatus ({{:.1f}}%).', pl, pv / pt * 100) FROM f
    UNION ALL SELECT 4, 'top', format('Top o_orderstatus: "{{}}" with {{:.2f}}', bl, CASE WHEN bv >= 1e9 THEN bv / 1e9 ELSE bv / 1e6 END)
      || CASE WHEN bv >= 1e9 THEN 'B' ELSE 'M' END || ' in o_totalprice.' FROM f
    UNION ALL SELECT 5, 'trend', format('o_totalprice shows a {{}} trend over {{}} periods.',
      CASE WHEN l1 > l0 THEN 'upward' WHEN l1 < l0 THEN 'downward' ELSE 'flat' END, ln) FROM f""",
)
def _(t):
    return views.insights(order_board(t))


@query(
    "kpi_cards",
    """SELECT 0 AS position, 'Total Records' AS label, CAST(count(*) AS DOUBLE) AS value, 'Dataset Size' AS sub, '6 columns' AS note,
      TRUE AS trend_up FROM orders
    UNION ALL SELECT 1, 'o_totalprice', round(sum(o_totalprice), 4), 'Total SUM', format('Avg {:.2f}K', avg(o_totalprice) / 1000), TRUE FROM orders
    UNION ALL SELECT 2, 'o_totalprice', round(avg(o_totalprice), 4), 'Average', format('Max {:.2f}K', max(o_totalprice) / 1000), max(o_totalprice) > avg(o_totalprice) FROM orders
    UNION ALL SELECT 3, 'o_totalprice', max(o_totalprice), 'Peak Value', format('Min {:.2f}K', min(o_totalprice) / 1000), TRUE FROM orders""",
)
def _(t):
    return views.kpi_cards(order_board(t))


@query(
    "ranked_bars",
    """SELECT CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank, left(o_orderstatus, 22) AS label,
      o_totalprice AS value FROM orders QUALIFY rank <= 5""",
)
def _(t):
    return views.ranked_bars(order_board(t))


@query(
    "type_pills",
    f"""WITH d AS ({ORDER_BOARD})
    SELECT 0 AS position, concat(count(*) FILTER (item = 'numeric_cols'), ' Numeric') AS pill FROM d
    UNION ALL SELECT 1, concat(count(*) FILTER (item = 'categorical_cols'), ' Category') FROM d
    UNION ALL SELECT 2, concat(count(*) FILTER (item = 'date_cols'), ' Date') FROM d
    UNION ALL SELECT 3, concat(printf('%.1f', max(value) FILTER (item = 'null_pct')), '% Null') FROM d""",
)
def _(t):
    return views.type_pills(order_board(t))


@query("dashboard_payload")
def _(t):
    return views.payload(order_board(t))
