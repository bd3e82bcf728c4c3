"""Column, row, filter, sort, cleaning, sheet, source and catalog queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import formatting
from tablewright.operators import cleaning, columns, edits, filters, ordering
from tablewright.operators.profile import coerce, profile
from tablewright.operators.rowindex import dense_index, file_index, running_total
from tablewright.plans.recipe import run_recipe
from tablewright.session import scratch_path
from tablewright.sources import catalog, readers, sheets, writers
from tablewright.sources.indexed import IndexedTable
from tablewright.streaming.ingest import ingest_folder, ingested
from workload.derived import (
    MESSY_CUSTOMERS_SQL,
    messy_customers,
    messy_prices,
    messy_prices_sql,
    sheet_grid,
)
from workload.registry import query
from workload.values import num_sql, prefix_sql


def customers(t):
    return dense_index(t("customer"), ["c_custkey"])


CUSTOMERS = "(SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_index, * FROM customer)"
ORDERS = "(SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_index, * FROM orders)"


def orders(t):
    return dense_index(t("orders"), ["o_orderdate", "o_orderkey"])


def indexed_orders(t) -> IndexedTable:
    return IndexedTable.create(t("orders"), scratch_path(t.spark), ["o_orderdate", "o_orderkey"])


# -- columns --------------------------------------------------------------------------------------


@query(
    "clean_column_names",
    "SELECT c_custkey AS total_sales, c_name AS col_1, c_nationkey AS col_2, c_acctbal AS a, c_mktsegment AS a_1 FROM customer",
)
def _(t):
    return columns.clean_columns(t("customer").toDF(" Total Sales ($) ", "Unnamed: 0", "nan", "a", "A!"))


@query("add_column", "SELECT *, 'none' AS note, '' AS \"Column_7\" FROM customer")
def _(t):
    return columns.add_column(columns.add_column(t("customer"), "note", "none"))


@query("uppercase_columns", "SELECT p_partkey AS \"P_PARTKEY\", p_name AS \"P_NAME\" FROM part")
def _(t):
    return columns.uppercase_columns(t("part").select("p_partkey", "p_name"))


@query(
    "write_scalar_to_column",
    """SELECT s_suppkey, s_acctbal, CASE WHEN s_suppkey = (SELECT max(s_suppkey) FROM supplier)
      THEN CAST((SELECT round(avg(s_acctbal), 4) FROM supplier) AS VARCHAR) ELSE '' END AS mean_balance FROM supplier""",
)
def _(t):
    df = t("supplier").select("s_suppkey", "s_acctbal")
    return columns.function_to_column(df, "AVG", "s_acctbal", "mean_balance", index="s_suppkey")


@query(
    "transform_expressions",
    """SELECT o_orderkey, o_totalprice, round(o_totalprice * 0.1, 4) AS bonus,
      CASE WHEN o_totalprice > 250000 THEN 'large' ELSE 'small' END AS size FROM orders""",
)
def _(t):
    exprs = {
        "bonus": "round(o_totalprice * 0.1D, 4)",
        "size": "CASE WHEN o_totalprice > 250000 THEN 'large' ELSE 'small' END",
    }
    return columns.transform(t("orders").select("o_orderkey", "o_totalprice"), exprs=exprs)


@query("transform_batches", "SELECT o_orderkey, o_totalprice + o_custkey AS total FROM orders")
def _(t):
    def step(batch):
        return batch.assign(total=batch["o_totalprice"] + batch["o_custkey"])[["o_orderkey", "total"]]

    df = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return columns.transform_batches(df, step, "o_orderkey bigint, total double")


@query(
    "cast_labels",
    """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS customer, strftime(o_orderdate, '%Y-%m-%d') AS day,
      left(concat(o_orderpriority, ' ', strftime(o_orderdate, '%Y-%m-%d')), 22) AS ranked,
      CASE WHEN o_orderstatus = 'P' THEN concat('Row ', CAST(o_orderkey + 1 AS VARCHAR)) ELSE o_orderstatus END AS named
    FROM orders""",
)
def _(t):
    day = formatting.date_label(F.col("o_orderdate"))
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return t("orders").select(
        "o_orderkey",
        columns.label(F.col("o_custkey")).alias("customer"),
        day.alias("day"),
        formatting.ranked_label(F.concat("o_orderpriority", F.lit(" "), day), F.lit(1)).alias("ranked"),
        formatting.ranked_label(status, F.col("o_orderkey") + 1).alias("named"),
    )


# -- row edits --------------------------------------------------------------------------------------


@query(
    "update_cells",
    f"""SELECT row_index, c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal,
      CASE WHEN c_acctbal < 0 THEN 'REVIEW' ELSE c_mktsegment END AS c_mktsegment FROM {CUSTOMERS}""",
)
def _(t):
    table = customers(t)
    fixes = table.where("c_acctbal < 0").select(
        "row_index",
        F.inline(
            F.array(
                F.struct(F.lit("c_acctbal").alias("column"), F.lit("0.0").alias("value"), F.lit(0).alias("edit_no")),
                F.struct(F.lit("c_mktsegment").alias("column"), F.lit("first").alias("value"), F.lit(0).alias("edit_no")),
                F.struct(F.lit("c_mktsegment").alias("column"), F.lit("REVIEW").alias("value"), F.lit(1).alias("edit_no")),
            )
        ),
    )
    return edits.update_cells(table, fixes)


@query(
    "append_rows",
    f"""SELECT * FROM {CUSTOMERS}
    UNION ALL SELECT (SELECT count(*) FROM customer), NULL, 'New', NULL, 10.5, ''
    UNION ALL SELECT (SELECT count(*) FROM customer) + 1, NULL, '', 3, NULL, 'AUTO'""",
)
def _(t):
    return edits.append_rows(
        customers(t), [{"c_name": "New", "c_acctbal": 10.5, "other": 1}, {"c_nationkey": 3, "c_mktsegment": "AUTO"}]
    )


@query(
    "delete_rows",
    f"""SELECT row_number() OVER (ORDER BY row_index) - 1 AS row_index, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment
    FROM {CUSTOMERS} WHERE row_index NOT IN (0, 7, 120)""",
)
def _(t):
    return edits.delete_rows(customers(t), [7, 0, 120])


GAPPED = "(SELECT 2 * o_orderkey + 1 AS row_index, o_orderkey, o_orderkey % 3 = 0 AS gone FROM orders)"


@query(
    "delete_rows_many",
    f"""SELECT row_index - below AS row_index, o_orderkey FROM (
      SELECT *, coalesce(sum(CAST(gone AS BIGINT)) OVER (ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below FROM {GAPPED})
    WHERE NOT gone""",
)
def _(t):
    table = t("orders").select((F.col("o_orderkey") * 2 + 1).alias("row_index"), "o_orderkey")
    return edits.delete_rows(table, table.where("o_orderkey % 3 = 0").select("row_index"))


@query(
    "update_cells_rejects",
    f"""SELECT row_index, "column", value, reason FROM (
      SELECT row_index, 'c_acctbal' AS "column", 'n/a' AS value, 'bad value' AS reason FROM {CUSTOMERS} WHERE c_acctbal < 0
      UNION ALL SELECT row_index + (SELECT count(*) FROM customer), 'c_name', 'x', 'unknown row' FROM {CUSTOMERS} WHERE c_nationkey = 3
      UNION ALL SELECT row_index, 'c_nosuch', 'x', 'unknown column' FROM {CUSTOMERS} WHERE c_nationkey = 4)""",
)
def _(t):
    table, n = customers(t), t("customer").count()

    def edit(where, shift, name, value):
        return table.where(where).select((F.col("row_index") + shift).alias("row_index"), F.lit(name).alias("column"), F.lit(value).alias("value"))

    asked = [("c_acctbal < 0", 0, "c_acctbal", "n/a"), ("c_nationkey = 3", n, "c_name", "x"), ("c_nationkey = 4", 0, "c_nosuch", "x"), ("c_nationkey = 5", 0, "c_acctbal", "1.5")]
    return edits.rejected_edits(table, reduce(DataFrame.unionByName, [edit(*a) for a in asked]))


EDITED = f"""(SELECT row_number() OVER (ORDER BY row_index) - 1 AS row_index, o_orderkey, o_orderpriority,
  CASE WHEN o_custkey % 7 = 0 THEN '' ELSE o_orderstatus END AS o_orderstatus FROM {ORDERS} WHERE o_custkey % 5 > 0)"""


@query("indexed_edits", f"SELECT * FROM {EDITED}")
def _(t):
    return edited_orders(t).rows().drop("o_orderdate", "o_custkey")


@query("indexed_edits_page", f"SELECT * FROM {EDITED} WHERE row_index BETWEEN 1000 AND 1499")
def _(t):
    return edited_orders(t).page(3, 500).drop("o_orderdate", "o_custkey")


@query("indexed_edits_compacted", f"SELECT * FROM {EDITED}")
def _(t):
    table = edited_orders(t)
    table.compact()
    return table.rows().drop("o_orderdate", "o_custkey")


def edited_orders(t) -> IndexedTable:
    """Orders without every fifth customer's, then with a blank status for every seventh customer's."""
    table = IndexedTable.create(t("orders").select("o_orderdate", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"), scratch_path(t.spark), ["o_orderdate", "o_orderkey"])
    table.delete(table.rows().where("o_custkey % 5 = 0").select("row_index"))
    table.update(table.rows().where("o_custkey % 7 = 0").select("row_index", F.lit("o_orderstatus").alias("column"), F.lit("").alias("value")))
    return table


@query(
    "sorted_page",
    """SELECT CAST(row_number() OVER (ORDER BY o_totalprice DESC, row_index) - 1 AS BIGINT) AS position, row_index, o_orderkey, o_totalprice
    FROM """
    + ORDERS
    + " QUALIFY position BETWEEN 200 AND 299",
)
def _(t):
    return indexed_orders(t).sorted_page("o_totalprice", 3, 100, ascending=False).select("position", "row_index", "o_orderkey", "o_totalprice")


# -- filters ----------------------------------------------------------------------------------------


@query(
    "search_any_column",
    """SELECT * FROM part WHERE concat_ws(chr(1), lower(CAST(p_partkey AS VARCHAR)), lower(p_name), lower(p_brand),
      lower(p_type), CAST(p_size AS VARCHAR), CAST(p_retailprice AS VARCHAR)) LIKE '%d#1%'
      OR concat_ws(chr(1), p_name) LIKE '%D#1%'""",
)
def _(t):
    return filters.search(t("part"), "D#1")


@query("search_long_texts", "SELECT doc_id FROM documents WHERE lower(text) LIKE '%license%' OR lower(source) LIKE '%license%'")
def _(t):
    return filters.search(t("documents"), "License", ["text", "source"]).select("doc_id")


@query(
    "complete_cases",
    f"""SELECT o_orderkey, price_txt FROM (SELECT o_orderkey, {num_sql('price_txt')} AS price_txt FROM {messy_prices_sql()})
    WHERE price_txt IS NOT NULL""",
)
def _(t):
    df = messy_prices(t("orders")).select("o_orderkey", "price_txt")
    return filters.complete_cases(coerce(df, profile(df)), ["o_orderkey", "price_txt"])


# -- order ------------------------------------------------------------------------------------------


@query(
    "dense_row_index",
    f"SELECT row_index, o_orderkey FROM {ORDERS}",
)
def _(t):
    return dense_index(t("orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select(
        "row_index", "o_orderkey"
    )


@query("file_row_index", "SELECT o_orderkey AS row_index, o_orderkey FROM orders")
def _(t):
    return file_index(t("orders")).select("row_index", "o_orderkey")


@query(
    "running_total",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, sum(l_quantity) OVER (ORDER BY l_shipdate, l_orderkey, "
    "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING) AS running FROM lineitem",
)
def _(t):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return running_total(t("lineitem").select(*order), order, "l_quantity", "running").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "running"
    )


@query(
    "sort_mixed_column",
    f"""SELECT CAST(row_number() OVER (ORDER BY {prefix_sql('price_txt')} ASC NULLS LAST,
        CASE WHEN {prefix_sql('price_txt')} IS NULL THEN lower(price_txt) END ASC NULLS LAST, o_orderkey) - 1 AS BIGINT) AS position,
      o_orderkey, price_txt FROM {messy_prices_sql()}""",
)
def _(t):
    df = messy_prices(t("orders")).select("o_orderkey", "price_txt")
    return ordering.sorted_index(df, "price_txt", True, ["o_orderkey"], "position")


@query(
    "sort_mixed_column_descending",
    f"""SELECT CAST(row_number() OVER (ORDER BY {prefix_sql('price_txt')} DESC NULLS LAST,
        CASE WHEN {prefix_sql('price_txt')} IS NULL THEN lower(price_txt) END DESC NULLS LAST, o_orderkey) - 1 AS BIGINT) AS position,
      o_orderkey FROM {messy_prices_sql()}""",
)
def _(t):
    df = messy_prices(t("orders")).select("o_orderkey", "price_txt")
    return ordering.sorted_index(df, "price_txt", False, ["o_orderkey"], "position").drop("price_txt")


# Words whose order by code points, by letters alone and by the Unicode collation differ.
_WORDS = ["zebra", "Éclair", "eclair", "Zebra", "éclair", "Eclair", "apple", "Äpfel", "_x", "naïve", "Naive", "-dash", "straße", "Strasse", "co-op", "coop", "12 monkeys", "  "]
_LABELS = f"CASE o_orderkey % {len(_WORDS) + 1} " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(_WORDS)) + " END"


def _labels_ranked(direction: str) -> str:
    number = prefix_sql("label")
    return f"""SELECT CAST(row_number() OVER (ORDER BY {number} {direction} NULLS LAST,
        (CASE WHEN {number} IS NULL THEN label END) COLLATE "en" {direction} NULLS LAST, o_orderkey) - 1 AS BIGINT) AS position,
      o_orderkey, label FROM (SELECT o_orderkey, {_LABELS} AS label FROM orders)"""


@query("sort_by_locale", _labels_ranked("ASC"))
def _(t):
    labels = t("orders").select("o_orderkey", F.expr(_LABELS).alias("label"))
    return ordering.sorted_index(labels, "label", True, ["o_orderkey"], "position")


@query("sort_by_locale_descending", _labels_ranked("DESC"))
def _(t):
    labels = t("orders").select("o_orderkey", F.expr(_LABELS).alias("label"))
    return ordering.sorted_index(labels, "label", False, ["o_orderkey"], "position")


@query("sort_rows", "SELECT * FROM supplier")
def _(t):
    return ordering.sort_rows(t("supplier"), "s_acctbal", ascending=False, tie=["s_suppkey"])


@query("page_of_rows", f"SELECT * FROM {ORDERS} WHERE row_index BETWEEN 1000 AND 1499")
def _(t):
    return indexed_orders(t).page(3, 500)


@query(
    "page_info",
    """SELECT count(*) AS "count", 3 AS page, CASE WHEN count(*) > 300 THEN 4 END AS "next", 2 AS previous FROM orders""",
)
def _(t):
    return ordering.page_info(t("orders"), 3)


@query("viewport", f"SELECT * FROM {ORDERS} WHERE row_index >= 250 AND row_index < 290")
def _(t):
    return indexed_orders(t).viewport(250, 290)


@query(
    "top_rows",
    """SELECT CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank, o_orderstatus, o_orderpriority,
      round(CAST(o_orderkey AS DOUBLE), 4) AS o_orderkey, round(CAST(o_custkey AS DOUBLE), 4) AS o_custkey, round(o_totalprice, 4) AS o_totalprice
    FROM orders QUALIFY rank <= 5""",
)
def _(t):
    shown = ordering.top_columns(["o_orderstatus", "o_orderpriority"], ["o_orderkey", "o_custkey", "o_totalprice"], [])
    return ordering.top_rows(t("orders"), "o_totalprice", shown, ["o_orderkey"])


@query("preview", "SELECT * FROM part ORDER BY p_partkey LIMIT 5")
def _(t):
    return ordering.preview(t("part"), ["p_partkey"])


@query(
    "stride_sample",
    f"SELECT row_index, o_totalprice FROM {ORDERS} WHERE row_index % CAST(ceil((SELECT count(*) FROM orders) / 100.0) AS BIGINT) = 0",
)
def _(t):
    return indexed_orders(t).stride().select("row_index", "o_totalprice")


# -- cleaning -----------------------------------------------------------------------------------------

TRIM = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


@query(
    "trim_whitespace",
    f"""SELECT c_custkey, {TRIM.format(c='c_name')} AS c_name, {TRIM.format(c='c_mktsegment')} AS c_mktsegment
    FROM {MESSY_CUSTOMERS_SQL}""",
)
def _(t):
    return cleaning.trim_whitespace(messy_customers(t("customer")))


@query(
    "fill_empty",
    f"""SELECT c_custkey, coalesce(nullif({TRIM.format(c='c_name')}, ''), '0') AS c_name,
      coalesce(nullif({TRIM.format(c='c_mktsegment')}, ''), '0') AS c_mktsegment FROM {MESSY_CUSTOMERS_SQL}""",
)
def _(t):
    return cleaning.fill_empty(messy_customers(t("customer")))


@query(
    "remove_duplicates",
    """SELECT min(o_orderkey) AS row_index, o_custkey, o_orderstatus, o_orderpriority FROM orders
    GROUP BY o_custkey, o_orderstatus, o_orderpriority""",
)
def _(t):
    df = t("orders").select(F.col("o_orderkey").alias("row_index"), "o_custkey", "o_orderstatus", "o_orderpriority")
    return cleaning.remove_duplicates(df)


@query(
    "remove_duplicates_hot_rows",
    """SELECT min(l_orderkey * 10 + l_linenumber) AS row_index, l_returnflag, l_linestatus, l_tax FROM lineitem
    GROUP BY l_returnflag, l_linestatus, l_tax""",
)
def _(t):
    df = t("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_index"), "l_returnflag", "l_linestatus", "l_tax"
    )
    return cleaning.remove_duplicates(df)


@query(
    "null_to_blank",
    f"SELECT o_orderkey AS row_index, coalesce(price_txt, '') AS price_txt, CAST(o_custkey AS VARCHAR) AS o_custkey FROM {messy_prices_sql()}",
)
def _(t):
    df = messy_prices(t("orders")).select(F.col("o_orderkey").alias("row_index"), "price_txt", "o_custkey")
    return cleaning.null_to_blank(df)


@query(
    "cleaning_counts",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS col, count(*) FILTER ({TRIM.format(c=c)} <> {c}) AS untrimmed,
        count(*) FILTER ({TRIM.format(c=c)} = '') AS blank, count(*) FILTER ({c} IS NULL) AS missing FROM {MESSY_CUSTOMERS_SQL}"""
        for c in ("c_name", "c_mktsegment")
    ),
)
def _(t):
    return cleaning.cleaning_counts(messy_customers(t("customer")))


# -- sheets ---------------------------------------------------------------------------------------------


@query("drop_blank_rows_and_columns", "SELECT c_custkey, c_name FROM customer")
def _(t):
    base = t("customer").select("c_custkey", "c_name", F.lit(None).cast("string").alias("empty"))
    blank = t("nation").select(
        F.lit(None).cast("bigint").alias("c_custkey"), F.lit(None).cast("string").alias("c_name"), F.lit(None).cast("string").alias("empty")
    )
    return sheets.drop_blank_columns(sheets.drop_blank_rows(base.unionByName(blank)))


@query("detect_header_rows", "SELECT c_mktsegment AS sheet, CAST(2 AS BIGINT) AS header_idx FROM customer GROUP BY 1")
def _(t):
    return sheets.header_rows(sheet_grid(t("customer")))


@query(
    "label_predicate",
    f"""SELECT o_orderkey, coalesce(length(trim(price_txt)) BETWEEN 1 AND 80 AND {num_sql('price_txt')} IS NULL, FALSE) AS is_label
    FROM {messy_prices_sql()}""",
)
def _(t):
    return messy_prices(t("orders")).select("o_orderkey", sheets.is_label(F.col("price_txt")).alias("is_label"))


@query(
    "normalise_sheets",
    """SELECT c_mktsegment AS sheet, c_custkey + 3 AS row_idx, CAST(c_custkey AS DOUBLE) AS customer_key, c_name AS name,
      c_acctbal AS acct_balance, CASE WHEN c_nationkey = 0 THEN 'home' ELSE CAST(c_nationkey AS VARCHAR) END AS name_1 FROM customer""",
)
def _(t):
    return sheets.normalise(sheet_grid(t("customer")))


@query(
    "whole_column_numbers",
    f"""SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS customer, price_txt FROM {messy_prices_sql()}""",
)
def _(t):
    df = messy_prices(t("orders")).select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"), "price_txt")
    return readers.numeric_where_whole(df)


@query(
    "tagged_union",
    """SELECT 'customer' AS _sheet, c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal, NULL FROM supplier""",
)
def _(t):
    c = t("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    s = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return sheets.tagged_union({"customer": c, "supplier": s})


# -- sources and catalog -----------------------------------------------------------------------------------


@query(
    "rows_from_documents",
    "SELECT event_id AS row_index, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS missing FROM events",
)
def _(t):
    rows = t("events").select(F.col("event_id").alias("row_index"), F.col("props").alias("data"))
    return readers.rows_to_table(rows, ["k", "missing"])


@query(
    "json_records",
    "SELECT json_extract_string(props, '$.k') AS k, CAST(user_id AS VARCHAR) AS \"user\" FROM events",
)
def _(t):
    user = F.concat(F.lit('{"user": '), F.col("user_id").cast("string"), F.lit(", "), F.expr("substring(props, 2)"), F.lit("]"))
    return readers.from_documents(t("events").select(F.concat(F.lit("["), user).alias("doc")), "doc", "records")


@query(
    "json_split_documents",
    "SELECT CAST(o_custkey AS VARCHAR) AS customer, o_orderstatus AS status FROM orders",
)
def _(t):
    doc = F.concat(
        F.lit('{"columns": ["customer", "status"], "index": [0], "data": [['),
        F.col("o_custkey").cast("string"), F.lit(', "'), F.col("o_orderstatus"), F.lit('"]]}'),
    )
    return readers.from_documents(t("orders").select(doc.alias("doc")), "doc", "split")


@query("row_documents", """SELECT c_custkey AS row_index, concat('{"c_name":"', c_name, '","c_nationkey":', CAST(c_nationkey AS VARCHAR),
    ',"c_acctbal":', CASE WHEN c_acctbal < 0 THEN 'null' ELSE CAST(c_acctbal AS VARCHAR) END, '}') AS data FROM customer""")
def _(t):
    df = t("customer").select(
        F.col("c_custkey").alias("row_index"),
        "c_name",
        "c_nationkey",
        F.when(F.col("c_acctbal") < 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
    )
    return writers.row_documents(df)


@query(
    "delimited_lines",
    """SELECT c_custkey, concat('"', c_custkey, '","', replace(concat(c_name, ' "x"'), '"', '""'), '","',
      CASE WHEN c_nationkey = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END, '"') AS line FROM customer""",
)
def _(t):
    df = t("customer").select(
        "c_custkey", F.concat("c_name", F.lit(' "x"')).alias("c_name"), F.nullif(F.col("c_nationkey"), F.lit(0)).alias("c_nationkey")
    )
    return df.select("c_custkey", writers.delimited_lines(df, ["c_custkey", "c_name", "c_nationkey"]).alias("line"))


@query(
    "parse_delimited_lines",
    "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_type AS \"type\" FROM part",
)
def _(t):
    df = t("part").select("p_partkey", "p_name", "p_type")
    lines = df.select(writers.delimited_lines(df, df.columns).alias("line"))
    return readers.parse_lines(lines, F.col("line"), ["id", "name", "type"])


@query(
    "delete_cascade",
    """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') GROUP BY 1""",
)
def _(t):
    dead = t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    left = catalog.without_datasets(t("lineitem"), dead, "l_orderkey")
    return left.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


@query(
    "owner_lookup",
    "SELECT o_orderkey, c_name AS owner FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def _(t):
    return catalog.with_owner(t("orders"), t("customer"), "o_custkey", "c_custkey").select(
        "o_orderkey", F.col("c_name").alias("owner")
    )


@query(
    "csv_round_trip",
    """SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name, c_mktsegment, CAST(c_nationkey AS DOUBLE) AS c_nationkey,
      c_acctbal FROM customer""",
)
def _(t):
    path = scratch_path(t.spark)
    writers.write_delimited(t("customer"), path, ["c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal"])
    return readers.read_table(t.spark, path, fmt="csv")


@query("indexed_load", f"SELECT row_index, o_orderkey, o_custkey FROM {ORDERS} WHERE row_index BETWEEN 500 AND 999")
def _(t):
    path = scratch_path(t.spark)
    columns = t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    loaded = writers.load_indexed(columns, path, ["o_orderdate", "o_orderkey"])
    return ordering.page(loaded, 2, 500).drop("o_orderdate")


@query("catalog_ingest", f"SELECT row_index, o_orderkey, o_orderstatus, o_totalprice FROM {ORDERS}")
def _(t):
    datasets = catalog.Catalog(t.spark, scratch_path(t.spark))
    dataset = datasets.register("owner", t.path("orders"))
    datasets.ingest(dataset, "owner", order_by=["o_orderdate", "o_orderkey"])
    return datasets.rows(dataset, "owner").select("row_index", "o_orderkey", "o_orderstatus", "o_totalprice")


@query("incremental_ingest", "SELECT event_id AS row_index, event_id, event_type, value FROM events")
def _(t):
    target = scratch_path(t.spark)
    only = {"pathGlobFilter": "events.parquet"}
    ingest_folder(t.spark, t.folder, t("events").schema, target, f"{target}/mark", "parquet", only).awaitTermination()
    return ingested(t.spark, target).select("row_index", "event_id", "event_type", "value")


# -- recipes ----------------------------------------------------------------------------------------------


@query(
    "recipe",
    """SELECT o_orderstatus, o_totalprice, CAST('' AS VARCHAR) AS note, round(o_totalprice * 0.1, 4) AS bonus, o_orderkey AS row_index
    FROM orders WHERE o_orderstatus <> 'P'""",
)
def _(t):
    table = t("orders").select("o_orderstatus", "o_totalprice", F.col("o_orderkey").alias("row_index"))
    return run_recipe(
        table,
        [
            {"action": "message"},
            {"action": "trim"},
            {"action": "keep", "condition": "o_orderstatus <> 'P'"},
            {"action": "add_column", "column_name": "note"},
            {"action": "expr", "columns": {"bonus": "round(o_totalprice * 0.1D, 4)"}},
            {"action": "sort", "colName": "o_totalprice", "ascending": False},
        ],
    )
