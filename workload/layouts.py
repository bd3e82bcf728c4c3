"""Queries over files and documents in every layout: line breaks, ragged rows, order of names and of rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.session import scratch_path
from tablewright.sources import readers, sheets, writers
from tablewright.sources.catalog import Catalog
from workload.registry import query


def named(df: DataFrame) -> DataFrame:
    """The table with its column names in order, which a comparison by name would not see."""
    return df.withColumn("column_order", F.lit(",".join(df.columns)))


def write_lines(df: DataFrame, line: Column, header: str, path: str) -> str:
    """Lines as they are, below a header in each file."""
    df.select(line.alias(header)).write.options(header=True, sep="\x01", quote="\x02", escape="\x02", emptyValue="").csv(path)
    return path


# -- delimited text ---------------------------------------------------------------------------------


@query(
    "csv_line_breaks",
    """SELECT CAST(c_custkey AS DOUBLE) AS id, concat(c_name, chr(10), c_mktsegment, ', "', c_nationkey, '"', chr(10)) AS note,
      CASE WHEN c_custkey % 3 = 0 THEN concat(chr(10), c_acctbal) ELSE 'plain' END AS more, 'id,note,more' AS column_order FROM customer""",
)
def _(t):
    lf = F.lit("\n")
    df = t("customer").select(
        F.col("c_custkey").alias("id"),
        F.concat("c_name", lf, "c_mktsegment", F.lit(', "'), "c_nationkey", F.lit('"'), lf).alias("note"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(lf, "c_acctbal")).otherwise("plain").alias("more"),
    )
    path = scratch_path(t.spark)
    writers.write_delimited(df, path)
    return named(readers.read_csv(t.spark, path))


@query(
    "csv_ragged_rows",
    """SELECT CAST(o_orderkey AS DOUBLE) AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS status,
      CASE WHEN o_orderkey % 3 = 2 THEN concat(o_orderpriority, ', late') END AS col_2, 'id,status,col_2' AS column_order FROM orders""",
)
def _(t):
    line = F.concat_ws(
        ",",
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")),
        F.when(F.col("o_orderkey") % 3 == 2, F.concat(F.lit('"'), "o_orderpriority", F.lit(', late"'))),
    )
    return named(readers.read_table(t.spark, write_lines(t("orders"), line, "Id,Status", scratch_path(t.spark)), "csv"))


@query(
    "text_grid_cells",
    """SELECT p_brand AS sheet, p_partkey AS row_idx, p_name AS c0, concat(p_type, '|', p_size) AS c1, CAST(NULL AS VARCHAR) AS c2,
      CAST(p_partkey AS VARCHAR) AS c3, 4 AS n_cells FROM part""",
)
def _(t):
    line = F.concat(F.col("p_name"), F.lit('|"'), "p_type", F.lit("|"), "p_size", F.lit('"||'), "p_partkey")
    grid = sheets.text_grid(t("part"), F.col("p_brand"), F.col("p_partkey"), line, "|")
    return grid.select("sheet", "row_idx", *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(4)], F.size("cells").alias("n_cells"))


# -- JSON ---------------------------------------------------------------------------------------------

ROWS = """SELECT o_orderstatus AS zone, CAST(o_custkey AS VARCHAR) AS qty, CAST(o_orderkey AS VARCHAR) AS amount,
  'zone,qty,amount' AS column_order FROM orders"""


def documents(t, layout: str) -> DataFrame:
    """One document of each order: ``layout`` with its cells for $Z, $Q and $A."""
    cell = {"$Z": F.concat(F.lit('"'), "o_orderstatus", F.lit('"')), "$Q": F.col("o_custkey"), "$A": F.col("o_orderkey")}
    parts = [cell.get(p, F.lit(p)) for p in re.split(r"(\$[ZQA])", layout)]
    return t("orders").select(F.concat(*parts).alias("doc"))


@query("json_order_of_records", ROWS)
def _(t):
    return named(readers.from_documents(documents(t, '[{"zone": $Z, "qty": $Q, "amount": $A}]'), "doc", "records"))


@query("json_order_of_index", ROWS)
def _(t):
    return named(readers.from_documents(documents(t, '{"r$Q": {"zone": $Z, "qty": $Q, "amount": $A}}'), "doc", "index"))


@query("json_order_of_split", ROWS)
def _(t):
    return named(readers.from_documents(documents(t, '{"columns": ["zone", "qty", "amount"], "index": [0], "data": [[$Z, $Q, $A]]}'), "doc", "split"))


@query("json_order_of_columns", ROWS)
def _(t):
    return named(readers.from_documents(documents(t, '{"zone": {"$Q": $Z}, "qty": {"$Q": $Q}, "amount": {"$Q": $A}}'), "doc", "columns"))


@query("json_order_of_lists", ROWS)
def _(t):
    return named(readers.from_documents(documents(t, '{"zone": [$Z], "qty": [$Q], "amount": [$A]}'), "doc", "lists"))


@query(
    "json_order_of_values",
    "SELECT "
    + ", ".join(f"CAST(o_orderkey + {i} AS VARCHAR) AS \"{i}\"" for i in range(12))
    + ", '0,1,2,3,4,5,6,7,8,9,10,11' AS column_order FROM orders",
)
def _(t):
    cells = F.concat_ws(", ", *[F.col("o_orderkey") + i for i in range(12)])
    return named(readers.from_documents(t("orders").select(F.concat(F.lit("[["), cells, F.lit("]]")).alias("doc")), "doc", "values"))


@query(
    "json_files_in_order",
    "SELECT o_orderkey AS row_index, o_orderstatus AS zone, o_custkey AS qty, o_totalprice AS amount, 'row_index,zone,qty,amount' AS column_order FROM orders",
)
def _(t):
    path = scratch_path(t.spark)
    in_files(t("orders").select(F.col("o_orderstatus").alias("zone"), F.col("o_custkey").alias("qty"), F.col("o_totalprice").alias("amount"), "o_orderkey")).drop("o_orderkey", "_size").write.json(path)
    return named(ingested(t, path, "jsonl"))


# -- order of rows ------------------------------------------------------------------------------------


def in_files(df: DataFrame) -> DataFrame:
    """Orders by their key in files of very unequal size: each holds a few sizes of keys, a size twice as many as the one before."""
    size = F.floor(F.log2(F.col("o_orderkey") + 1))
    return df.withColumn("_size", size).repartitionByRange(4, "_size").sortWithinPartitions("_size", "o_orderkey")


def ingested(t, path: str, fmt: str) -> DataFrame:
    datasets = Catalog(t.spark, scratch_path(t.spark))
    dataset = datasets.register("owner", path)
    datasets.ingest(dataset, "owner", fmt=fmt)
    return datasets.rows(dataset, "owner")


@query("catalog_ingest_in_file_order", "SELECT o_orderkey AS row_index, o_orderkey, o_orderstatus FROM orders")
def _(t):
    path = scratch_path(t.spark)
    in_files(t("orders").select("o_orderkey", "o_orderstatus")).drop("_size").write.parquet(path)
    return ingested(t, path, "parquet")


@query("csv_ingest_in_file_order", "SELECT o_orderkey AS row_index, CAST(o_orderkey AS DOUBLE) AS o_orderkey, concat(o_orderstatus, chr(10), o_custkey) AS note FROM orders")
def _(t):
    path = scratch_path(t.spark)
    noted = t("orders").select("o_orderkey", F.concat("o_orderstatus", F.lit("\n"), "o_custkey").alias("note"))
    writers.write_delimited(in_files(noted), path, ["o_orderkey", "note"])
    return ingested(t, path, "csv")
