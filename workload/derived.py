"""Messy variants of the test tables, each as a Spark expression and the same in SQL.

The key rules only decide how a cell is spelled; no row is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MONEY_TEXT = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS {text})"


def _priced(text_type: str, bad_every: str) -> str:
    p = MONEY_TEXT.format(text=text_type)
    return f"""CASE WHEN o_orderkey % 17 = 0 THEN NULL
        WHEN o_orderkey % 23 = 0 THEN ''
        WHEN o_orderkey % {bad_every} = 0 THEN 'n/a'
        WHEN o_orderkey % 5 = 0 THEN concat('$', {p})
        WHEN o_orderkey % 7 = 0 THEN concat(' ', {p}, ' ')
        ELSE {p} END"""


def messy_prices(orders: DataFrame, bad_every: int = 29) -> DataFrame:
    """Orders with ``price_txt``: missing, blank, ``n/a``, ``$`` signs and padding."""
    return orders.withColumn("price_txt", F.expr(_priced("STRING", str(bad_every))))


def messy_prices_sql(bad_every: int = 29) -> str:
    return f"(SELECT *, {_priced('VARCHAR', str(bad_every))} AS price_txt FROM orders)"


def messy_dates(orders: DataFrame) -> DataFrame:
    """Orders with dates as text: ISO, US, and mixes where a quarter and a half are US."""
    iso, us = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "MM/dd/yyyy")
    return orders.select(
        "o_orderkey",
        iso.alias("d_iso"),
        us.alias("d_us"),
        F.when(F.col("o_orderkey") % 4 == 3, us).otherwise(iso).alias("d_mix75"),
        F.when(F.col("o_orderkey") % 2 == 1, us).otherwise(iso).alias("d_mix50"),
    )


MESSY_DATES_SQL = """(SELECT o_orderkey,
    strftime(o_orderdate, '%Y-%m-%d') AS d_iso,
    strftime(o_orderdate, '%m/%d/%Y') AS d_us,
    CASE WHEN o_orderkey % 4 = 3 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d_mix75,
    CASE WHEN o_orderkey % 2 = 1 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d_mix50
  FROM orders)"""


def messy_customers(customer: DataFrame) -> DataFrame:
    """Customers with padded names and blank or missing segments."""
    key = F.col("c_custkey")
    return customer.select(
        "c_custkey",
        F.when(key % 3 == 0, F.concat(F.lit("  "), "c_name", F.lit("\t"))).otherwise(F.col("c_name")).alias("c_name"),
        F.when(key % 13 == 0, F.lit(None))
        .when(key % 11 == 0, F.lit(" "))
        .otherwise(F.col("c_mktsegment"))
        .alias("c_mktsegment"),
    )


MESSY_CUSTOMERS_SQL = """(SELECT c_custkey,
    CASE WHEN c_custkey % 3 = 0 THEN concat('  ', c_name, chr(9)) ELSE c_name END AS c_name,
    CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN ' ' ELSE c_mktsegment END AS c_mktsegment
  FROM customer)"""


def size_classes(lineitem: DataFrame) -> DataFrame:
    """Line items with a category of geometrically growing size."""
    level = F.floor(F.log2(F.col("l_partkey") + 1))
    return lineitem.withColumn("size_class", F.concat(F.lit("c"), F.lpad(level.cast("string"), 2, "0")))


SIZE_CLASSES_SQL = """(SELECT *, concat('c', lpad(CAST(CAST(floor(log2(l_partkey + 1)) AS BIGINT) AS VARCHAR), 2, '0')) AS size_class
  FROM lineitem)"""


def sheet_grid(customer: DataFrame) -> DataFrame:
    """Raw sheets, one per market segment: title, blank row, header, then one row per customer.

    ``row_idx`` 0 to 2 hold title, blank and header; a customer sits at its key plus 3.
    """
    name = "c_mktsegment"
    cells = "array<string>"
    segments = customer.select(F.col(name).alias("sheet")).distinct()
    top = segments.select(
        "sheet",
        F.inline(
            F.array(
                F.struct(F.lit(0).cast("bigint").alias("row_idx"), F.array("sheet", *[F.lit(None)] * 4).cast(cells).alias("cells")),
                F.struct(F.lit(1).cast("bigint").alias("row_idx"), F.array(*[F.lit(None)] * 5).cast(cells).alias("cells")),
                F.struct(
                    F.lit(2).cast("bigint").alias("row_idx"),
                    F.array(F.lit("Customer Key"), F.lit("Name"), F.lit(None), F.lit("Acct. Balance"), F.lit("Name")).cast(cells).alias("cells"),
                ),
            )
        ),
    )
    body = customer.select(
        F.col(name).alias("sheet"),
        (F.col("c_custkey") + 3).alias("row_idx"),
        F.array(
            F.col("c_custkey").cast("string"),
            F.col("c_name"),
            F.lit(None),
            F.col("c_acctbal").cast("decimal(18,2)").cast("string"),
            F.when(F.col("c_nationkey") == 0, F.lit("home")).otherwise(F.col("c_nationkey").cast("string")),
        ).cast(cells).alias("cells"),
    )
    return top.unionByName(body)
