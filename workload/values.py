"""Parsing, formatting, profiling and column-function queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import formatting, parsing
from tablewright.operators import aggregates as agg
from tablewright.operators import profile as prof
from tablewright.operators.quantiles import exact_median, exact_quantiles
from tablewright.operators.rowindex import dense_index
from workload.derived import (
    MESSY_DATES_SQL,
    SIZE_CLASSES_SQL,
    messy_dates,
    messy_prices,
    messy_prices_sql,
    size_classes,
)
from workload.registry import query

NUM_RE = parsing.NUMBER
MONEY_RE = parsing.CURRENCY
PREFIX_RE = parsing.PREFIX


def num_sql(c: str) -> str:
    return f"(CASE WHEN regexp_matches({c}, '{NUM_RE}') THEN TRY_CAST(trim({c}) AS DOUBLE) END)"


def money_sql(c: str) -> str:
    bare = f"replace(replace({c}, ',', ''), '$', '')"
    return f"(CASE WHEN regexp_matches({bare}, '{MONEY_RE}') THEN TRY_CAST(trim(replace({bare}, '_', '')) AS DOUBLE) END)"


def prefix_sql(c: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({c}, '{PREFIX_RE}', 1), '') AS DOUBLE)"


@query("parse_number", f"SELECT o_orderkey, {num_sql('price_txt')} AS price FROM {messy_prices_sql()}")
def _(t):
    return messy_prices(t("orders")).select("o_orderkey", parsing.numeric(F.col("price_txt")).alias("price"))


@query("parse_currency", f"SELECT o_orderkey, {money_sql('price_txt')} AS price FROM {messy_prices_sql()}")
def _(t):
    return messy_prices(t("orders")).select("o_orderkey", parsing.currency(F.col("price_txt")).alias("price"))


@query(
    "parse_prefix",
    f"SELECT p_partkey, {prefix_sql('p_brand')} AS brand_value, "
    f"{prefix_sql('concat(CAST(p_size AS VARCHAR), p_brand)')} AS size_value FROM part",
)
def _(t):
    return t("part").select(
        "p_partkey",
        parsing.prefix(F.col("p_brand")).alias("brand_value"),
        parsing.prefix(F.concat(F.col("p_size").cast("string"), "p_brand")).alias("size_value"),
    )


@query(
    "parse_dates",
    f"""SELECT o_orderkey,
      strftime(try_strptime(d_iso, '%Y-%m-%d'), '%Y-%m-%d') AS iso,
      strftime(try_strptime(d_us, '%m/%d/%Y'), '%Y-%m-%d') AS us,
      strftime(try_strptime(d_mix75, '%Y-%m-%d'), '%Y-%m-%d') AS mixed
    FROM {MESSY_DATES_SQL}""",
)
def _(t):
    df = messy_dates(t("orders"))
    parsed = prof.parse_dates(df, ["d_iso", "d_us", "d_mix75"], ["o_orderkey"])
    iso, us, mixed = [formatting.date_label(c) for c in parsed.values()]
    return df.select("o_orderkey", iso.alias("iso"), us.alias("us"), mixed.alias("mixed"))


ODD = "CASE WHEN l_discount = 0 THEN CAST('inf' AS DOUBLE) WHEN l_tax = 0 THEN CAST('nan' AS DOUBLE) ELSE l_extendedprice * l_tax END"


@query(
    "safe_scalar",
    f"""SELECT l_orderkey, l_linenumber, CASE WHEN isfinite(v) THEN round(v, 4) END AS value
    FROM (SELECT l_orderkey, l_linenumber, {ODD} AS v FROM lineitem)""",
)
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", formatting.safe_scalar(F.expr(ODD)).alias("value"))


def _compact_sql(v: str) -> str:
    def scaled(unit, letter):
        return f"concat(CAST(CAST(round({v} * {unit}, 2) AS DECIMAL(18,2)) AS VARCHAR), '{letter}')"

    return f"""CASE WHEN {v} >= 1000000000 THEN {scaled('0.000000001', 'B')}
      WHEN {v} >= 1000000 THEN {scaled('0.000001', 'M')}
      WHEN {v} >= 1000 THEN {scaled('0.001', 'K')}
      ELSE regexp_replace(regexp_replace(CAST({v} AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') END"""


@query(
    "compact_number",
    f"""SELECT o_orderkey, {_compact_sql('p')} AS plain, {_compact_sql('p * 100')} AS hundredfold,
      {_compact_sql('p * 100000')} AS large
    FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) AS p FROM orders)""",
)
def _(t):
    p = F.col("o_totalprice").cast("decimal(18,2)")
    return t("orders").select(
        "o_orderkey",
        formatting.compact_number(p).alias("plain"),
        formatting.compact_number(p * 100).alias("hundredfold"),
        formatting.compact_number(p * 100000).alias("large"),
    )


def _indian_sql(v: str) -> str:
    s = f"CAST({v} AS VARCHAR)"
    w = f"split_part({s}, '.', 1)"
    frac = f"rtrim(split_part({s}, '.', 2), '0')"
    parts = [f"right({w}, 3)"]
    cases = [f"WHEN length({w}) <= 3 THEN {w}"]
    for size in (5, 7, 9, 11):
        at = size - 2
        cases.append(f"WHEN length({w}) <= {size} THEN concat(left({w}, length({w}) - {at}), ',', {', '.join(parts)})")
        parts = [f"substr({w}, length({w}) - {at + 1}, 2)", "','"] + parts
    return f"concat(CASE {' '.join(cases)} END, CASE WHEN {frac} = '' THEN '' ELSE concat('.', {frac}) END)"


@query(
    "indian_grouping",
    f"""SELECT o_orderkey, {_indian_sql('p')} AS price, {_indian_sql('p * 1000')} AS thousandfold
    FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) AS p FROM orders)""",
)
def _(t):
    p = F.col("o_totalprice").cast("decimal(18,2)")
    return t("orders").select(
        "o_orderkey",
        formatting.indian_grouping(p).alias("price"),
        formatting.indian_grouping(p * 1000).alias("thousandfold"),
    )


# -- profiles ---------------------------------------------------------------------------------

# Columns of each test table by kind: n(umber), s(tring), d(ate), a(rray).
TABLES = {
    "region": "r_regionkey:n r_name:s",
    "nation": "n_nationkey:n n_name:s n_regionkey:n",
    "customer": "c_custkey:n c_name:s c_nationkey:n c_acctbal:n c_mktsegment:s",
    "supplier": "s_suppkey:n s_name:s s_nationkey:n s_acctbal:n",
    "part": "p_partkey:n p_name:s p_brand:s p_type:s p_size:n p_retailprice:n",
    "orders": "o_orderkey:n o_custkey:n o_orderstatus:s o_totalprice:n o_orderdate:d o_orderpriority:s",
    "lineitem": "l_orderkey:n l_partkey:n l_suppkey:n l_linenumber:n l_quantity:n l_extendedprice:n "
    "l_discount:n l_tax:n l_returnflag:s l_linestatus:s l_shipdate:d",
    "events": "event_id:n ts:d user_id:n event_type:s value:n props:s",
    "documents": "doc_id:n text:s lang:s source:s n_chars:n",
    "labels": "doc_id:n quality:n toxic:n",
    "pages": "page_id:n url:s html:s",
    "benchmark": "item_id:n text:s",
    "conversations": "conv_id:n turn:n role:s text:s",
    "embeddings": "vec_id:n embedding:a label:n",
}


def profile_sql(source: str, columns: list[tuple[str, str]], num=num_sql, key: str = "1") -> str:
    """The role rules in SQL: numbers first, then ISO or US dates by the first value, then categories."""
    parts = []
    for pos, (c, kind) in enumerate(columns):
        n = f"count({c})"
        if kind != "s":
            role = {"n": "numeric", "d": "date", "a": "nested"}[kind]
            parts.append(
                f"""SELECT '{c}' AS col, {pos} AS pos, {n} AS n, CAST({n if kind == 'n' else 0} AS BIGINT) AS n_num,
                CAST({n if kind == 'd' else 0} AS BIGINT) AS n_date, CAST(NULL AS BIGINT) AS n_distinct,
                CASE WHEN {n} = 0 THEN 'empty' ELSE '{role}' END AS role, CAST(NULL AS VARCHAR) AS date_format FROM {source}"""
            )
            continue
        parts.append(
            f"""SELECT '{c}' AS col, {pos} AS pos, n, n_num,
              CASE WHEN role IN ('numeric', 'empty') THEN 0 ELSE n_date END AS n_date,
              CASE WHEN role = 'categorical' THEN u END AS n_distinct, role,
              CASE WHEN role = 'date' THEN fmt END AS date_format
            FROM (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN n_num >= 0.7 * n THEN 'numeric'
                WHEN n_date >= 0.6 * n THEN 'date' WHEN u <= greatest(50, 0.3 * n) THEN 'categorical' ELSE 'text' END AS role
              FROM (SELECT count(c) AS n, count({num('c')}) AS n_num, count(DISTINCT c) AS u, any_value(fmt) AS fmt,
                  count(CASE fmt WHEN 'Y-m-d' THEN try_strptime(c, '%Y-%m-%d') WHEN 'm/d/Y' THEN try_strptime(c, '%m/%d/%Y') END) AS n_date
                FROM (SELECT {c} AS c, (SELECT CASE WHEN regexp_matches(f, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN 'Y-m-d'
                      WHEN regexp_matches(f, '^\\d{{2}}/\\d{{2}}/\\d{{4}}$') THEN 'm/d/Y' END
                      FROM (SELECT arg_min({c}, {key}) AS f FROM {source})) AS fmt FROM {source})))"""
        )
    return " UNION ALL ".join(parts)


def _register_profile(table: str, spec: str) -> None:
    columns = [tuple(c.split(":")) for c in spec.split()]

    @query(f"profile_{table}", profile_sql(table, columns, key=columns[0][0]))
    def _(t):
        return prof.profile_frame(t(table), order_by=[columns[0][0]])


for _table, _spec in TABLES.items():
    _register_profile(_table, _spec)


@query("profile_prices", profile_sql(f"(SELECT price_txt FROM {messy_prices_sql()})", [("price_txt", "s")]))
def _(t):
    return prof.profile_frame(messy_prices(t("orders")).select("price_txt"))


@query(
    "profile_prices_rejected",
    profile_sql(f"(SELECT price_txt FROM {messy_prices_sql(3)})", [("price_txt", "s")]),
)
def _(t):
    return prof.profile_frame(messy_prices(t("orders"), 3).select("price_txt"))


@query(
    "profile_prices_as_money",
    profile_sql(f"(SELECT price_txt FROM {messy_prices_sql(3)})", [("price_txt", "s")], num=money_sql),
)
def _(t):
    return prof.profile_frame(messy_prices(t("orders"), 3).select("price_txt"), money=True)


@query(
    "profile_dates",
    profile_sql(
        MESSY_DATES_SQL,
        [("o_orderkey", "n"), ("d_iso", "s"), ("d_us", "s"), ("d_mix75", "s"), ("d_mix50", "s")],
        key="o_orderkey",
    ),
)
def _(t):
    return prof.profile_frame(messy_dates(t("orders")), order_by=["o_orderkey"])


ZONED = {"d_z": "Y-m-dTH:M:Sz", "d_offset": "Y-m-d H:M:Sz", "d_half": "m/d/Y I:M p", "d_short": "m/d/y"}


def zoned_dates(t) -> DataFrame:
    """Orders with a time of day, as text with zones, half days and two-digit years."""
    at = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"), F.lit(30))
    return t("orders").select(
        "o_orderkey",
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("d_z"),
        F.date_format(at, "yyyy-MM-dd HH:mm:ss'+05:30'").alias("d_offset"),
        F.date_format(at, "MM/dd/yyyy hh:mm a").alias("d_half"),
        F.date_format(at, "MM/dd/yy").alias("d_short"),
    )


@query(
    "profile_dates_with_zone",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS col, {i} AS pos, count(*) AS n, 0 AS n_num, count(*) AS n_date, CAST(NULL AS BIGINT) AS n_distinct, 'date' AS role, '{f}' AS date_format FROM orders"""
        for i, (c, f) in enumerate(ZONED.items())
    ),
)
def _(t):
    return prof.profile_frame(zoned_dates(t).drop("o_orderkey"))


@query(
    "parse_dates_with_zone",
    """SELECT o_orderkey, moment AS d_z, moment AS d_offset, moment AS d_half, CAST(CAST(moment AS DATE) AS TIMESTAMP) AS d_short
    FROM (SELECT o_orderkey, o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR + INTERVAL 30 MINUTE AS moment FROM orders)""",
)
def _(t):
    df = zoned_dates(t)
    found = prof.parse_dates(df, list(ZONED), ["o_orderkey"])
    return df.select("o_orderkey", *[c.alias(n) for n, c in found.items()])


# -- column functions ---------------------------------------------------------------------------

SQL_FUNCTIONS = {
    "SUM": "sum",
    "AVG": "avg",
    "AVERAGE": "avg",
    "MAX": "max",
    "MIN": "min",
    "COUNT": "count",
    "MEDIAN": "median",
    "STDEV": "stddev_pop",
    "VARIANCE": "var_pop",
}


def _register_function(fn: str) -> None:
    call = SQL_FUNCTIONS[fn]

    @query(
        f"function_{fn.lower()}",
        f"SELECT '{fn}' AS \"function\", 'l_quantity' AS \"column\", "
        f"round(CAST({call}(l_quantity) AS DOUBLE), 4) AS result FROM lineitem",
    )
    def _(t):
        return agg.column_function(t("lineitem"), fn, "l_quantity")


for _fn in SQL_FUNCTIONS:
    _register_function(_fn)


@query(
    "function_on_money_text",
    " UNION ALL ".join(
        f"SELECT '{fn}' AS \"function\", 'price_txt' AS \"column\", "
        f"round(CAST({SQL_FUNCTIONS[fn]}({money_sql('price_txt')}) AS DOUBLE), 4) AS result FROM {messy_prices_sql()}"
        for fn in ("AVG", "COUNT", "MEDIAN", "MIN")
    ),
)
def _(t):
    df = messy_prices(t("orders"))
    return reduce(DataFrame.union, [agg.column_function(df, fn, "price_txt") for fn in ("avg", "count", "median", "min")])


@query("median_by_narrowing", "SELECT count(*) AS n, round(median(l_extendedprice), 4) AS median FROM lineitem")
def _(t):
    found = exact_median(t("lineitem"), F.col("l_extendedprice"), limit=1000)
    return found.select("n", F.round("median", 4).alias("median"))


@query(
    "quantiles_by_narrowing",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(quantile_cont(l_extendedprice, 0.1), 4) AS low,
      round(median(l_extendedprice), 4) AS middle, round(quantile_cont(l_extendedprice, 0.9), 4) AS high FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    by = ["l_returnflag", "l_linestatus"]
    found = exact_quantiles(t("lineitem"), F.col("l_extendedprice"), [0.1, 0.5, 0.9], by, limit=1000)
    parts = [F.round(F.col("quantiles")[i], 4).alias(name) for i, name in enumerate(("low", "middle", "high"))]
    return found.select(*by, "n", *parts)


def kpi_sql(source: str, columns: list[str]) -> str:
    calls = {"sum": "sum", "mean": "avg", "min": "min", "max": "max", "std": "stddev_samp"}
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {i} AS position, '{stat}' AS stat, "
        f"round(CAST({call}(CAST({c} AS DOUBLE)) AS DOUBLE), 4) AS value FROM {source}"
        for i, c in enumerate(columns)
        for stat, call in calls.items()
    )


@query("kpi_block", kpi_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"]))
def _(t):
    return agg.kpi_block(t("orders"), ["o_orderkey", "o_custkey", "o_totalprice"])


@query(
    "null_percentage",
    f"""SELECT count(*) AS "rows", 7 * count(*) AS cells, count(*) - count(price) AS nulls,
      round((count(*) - count(price)) / (7.0 * count(*)) * 100, 2) AS null_pct
    FROM (SELECT {num_sql('price_txt')} AS price FROM {messy_prices_sql()})""",
)
def _(t):
    df = messy_prices(t("orders"))
    return agg.null_cells(prof.coerce(df, prof.profile(df)))


@query("distinct_count", "SELECT count(DISTINCT p_name) AS n_distinct FROM part")
def _(t):
    return agg.distinct_count(t("part"), "p_name")


def bar_sql(source: str, x: str, y: str) -> str:
    return f"""SELECT CAST(row_number() OVER (ORDER BY s DESC, label) AS INTEGER) AS rank, label, round(s, 4) AS value
    FROM (SELECT CAST({x} AS VARCHAR) AS label, sum(CAST({y} AS DOUBLE)) AS s FROM {source}
      WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY {x} ORDER BY s DESC, label LIMIT 15)"""


def counts_sql(source: str, x: str) -> str:
    return f"""SELECT CAST(row_number() OVER (ORDER BY n DESC, label) AS INTEGER) AS rank, label, n
    FROM (SELECT CAST({x} AS VARCHAR) AS label, count(*) AS n FROM {source}
      WHERE {x} IS NOT NULL GROUP BY 1 ORDER BY n DESC, label LIMIT 10)"""


def merged_sql(counts: str) -> str:
    return f"""SELECT CAST(row_number() OVER (ORDER BY first_rank) AS INTEGER) AS rank, label, CAST(n AS BIGINT) AS n
    FROM (SELECT CASE WHEN small THEN 'Other' ELSE label END AS label, small, sum(n) AS n, min(rank) AS first_rank
      FROM (SELECT *, count(*) OVER () > 7 AND n < 0.02 * sum(n) OVER () AS small FROM ({counts}))
      GROUP BY 1, 2)"""


@query("group_sum_top", bar_sql("orders", "o_orderstatus", "o_totalprice"))
def _(t):
    return agg.group_sum_top(t("orders"), "o_orderstatus", "o_totalprice")


@query("group_sum_top_many_groups", bar_sql("orders", "o_custkey", "o_totalprice"))
def _(t):
    return agg.group_sum_top(t("orders"), "o_custkey", "o_totalprice")


@query("value_counts_top", counts_sql("part", "p_brand"))
def _(t):
    return agg.value_counts_top(t("part"), "p_brand")


@query("merge_small_slices", merged_sql(counts_sql(SIZE_CLASSES_SQL, "size_class")))
def _(t):
    return agg.merge_small(agg.value_counts_top(size_classes(t("lineitem")), "size_class"))


@query(
    "share_of_total",
    f"""SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total, round(n / sum(n) OVER () * 100, 1) AS share
    FROM ({merged_sql(counts_sql('part', 'p_type'))})""",
)
def _(t):
    return agg.share_of_total(agg.merge_small(agg.value_counts_top(t("part"), "p_type")))


CELLS = "(SELECT row_number() OVER (ORDER BY c_custkey) AS r, * FROM customer)"


@query(
    "cell_formula",
    f"""WITH v AS (SELECT max(CASE WHEN r = 1 THEN c_acctbal END) AS a, max(CASE WHEN r = 2 THEN c_acctbal END) AS b,
        max(CASE WHEN r = 3 THEN c_nationkey END) AS c FROM {CELLS})
    SELECT '=SUM(D1,D2,2.5)' AS formula, CAST(round(a + b + 2.5, 4) AS VARCHAR) AS result FROM v
    UNION ALL SELECT '=MAX(D1,D2)', CAST(greatest(a, b) AS VARCHAR) FROM v
    UNION ALL SELECT '=MEDIAN(D1,D2,C3)', CAST(round(list_sort([a, b, CAST(c AS DOUBLE)])[2], 4) AS VARCHAR) FROM v
    UNION ALL SELECT '=COUNT(D1,B2,Z9,x)', '4' FROM v
    UNION ALL SELECT '=AVERAGE(D1,B2)', CAST(round(a / 2, 4) AS VARCHAR) FROM v
    UNION ALL SELECT '=VARIANCE(D1,D2)', CAST(round((a - b) * (a - b) / 4, 4) AS VARCHAR) FROM v""",
)
def _(t):
    table = dense_index(t("customer"), ["c_custkey"])
    formulas = ["=SUM(D1,D2,2.5)", "=MAX(D1,D2)", "=MEDIAN(D1,D2,C3)", "=COUNT(D1,B2,Z9,x)", "=AVERAGE(D1,B2)", "=VARIANCE(D1,D2)"]
    return reduce(DataFrame.union, [agg.cell_formula(table, f) for f in formulas])
