"""Queries over the catalog's records, refusals, ingest with bad files, the activity log, and large numbers as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import aggregates, cleaning, filters
from tablewright.operators.rowindex import dense_index
from tablewright.session import scratch_path
from tablewright.sources import sheets, writers
from tablewright.sources.catalog import Catalog
from tablewright.streaming.ingest import ingest_folder, ingest_status, ingested
from workload.derived import MESSY_CUSTOMERS_SQL, messy_customers, sheet_grid
from workload.registry import query
from workload.tables import CUSTOMERS, TRIM

# -- catalog ----------------------------------------------------------------------------------------


def catalog_of(t, **options) -> tuple[Catalog, dict[str, str]]:
    """Orders and suppliers taken in, parts registered only, and a file that is not there, of two owners."""
    datasets = Catalog(t.spark, scratch_path(t.spark), **options)
    ids = {
        "orders": datasets.register("ann", t.path("orders")),
        "parts": datasets.register("ann", t.path("part"), "All Parts"),
        "supplier": datasets.register("bob", t.path("supplier")),
        "absent": datasets.register("ann", scratch_path(t.spark) + ".parquet", "Absent"),
    }
    datasets.ingest(ids["orders"], "ann", order_by=["o_orderkey"])
    datasets.ingest(ids["supplier"], "bob", order_by=["s_suppkey"])
    try:
        datasets.ingest(ids["absent"], "ann")
    except ValueError:
        pass
    return datasets, ids


@query(
    "catalog_list",
    """SELECT 0 AS place, 'Absent' AS name, 'error' AS status, 0::BIGINT AS row_count, 0 AS col_count, '' AS columns, TRUE AS has_message, FALSE AS processed
    UNION ALL SELECT 1, 'All Parts', 'pending', 0, 0, '', FALSE, FALSE
    UNION ALL SELECT 2, 'orders.parquet', 'ready', count(*), 6, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority', FALSE, TRUE FROM orders""",
)
def _(t):
    datasets, _ = catalog_of(t)
    newest = [r["name"] for r in datasets.list("ann").collect()]
    place = F.array_position(F.array(*[F.lit(n) for n in newest]), F.col("name")).cast("int") - 1
    return datasets.list("ann").select(
        place.alias("place"), "name", "status", "row_count", "col_count", F.array_join("columns", ",").alias("columns"),
        (F.col("error_message") != "").alias("has_message"), F.col("processed_at").isNotNull().alias("processed"),
    )


@query(
    "catalog_compacted",
    """SELECT 'All Parts' AS name, 'pending' AS status, 0::BIGINT AS row_count, NULL::DOUBLE AS total, 2 AS removed_versions
    UNION ALL SELECT 'orders.parquet', 'ready', count(*), sum(round(o_totalprice)), 2 FROM orders
    UNION ALL SELECT 'supplier.parquet', 'ready', (SELECT count(*) FROM supplier), NULL, 2""",
)
def _(t):
    """The catalog after snapshots have taken the place of its records, and unnamed versions of rows have gone."""
    datasets, ids = catalog_of(t, compact_at=3)
    datasets.delete(ids["absent"], "ann")
    for _ in range(2):
        datasets.save(ids["orders"], "ann", datasets.rows(ids["orders"], "ann").withColumn("o_totalprice", F.round(F.col("o_totalprice").cast("double"))))
    removed = len(datasets.vacuum(0))
    total = datasets.rows(ids["orders"], "ann").agg(F.lit("orders.parquet").alias("name"), F.sum(F.col("o_totalprice").cast("double")).alias("total"))
    return datasets.datasets().join(total, "name", "left").select("name", "status", "row_count", "total", F.lit(removed).alias("removed_versions"))


@query(
    "catalog_search",
    """SELECT 'name' AS search, 'All Parts' AS name, 'Ann Lee' AS username UNION ALL SELECT 'owner', 'supplier.parquet', 'Bob Ray'
    UNION ALL SELECT 'status', 'orders.parquet', 'Ann Lee' UNION ALL SELECT 'status', 'supplier.parquet', 'Bob Ray'
    UNION ALL SELECT 'status and name', 'orders.parquet', 'Ann Lee'""",
)
def _(t):
    datasets, _ = catalog_of(t)
    users = t.spark.createDataFrame([("ann", "Ann Lee"), ("bob", "Bob Ray")], "owner_id string, username string")
    asked = {"name": {"text": "PARTS"}, "owner": {"text": "bob r"}, "status": {"status": "ready"}, "status and name": {"text": "orders", "status": "ready"}}
    return reduce(DataFrame.unionByName, [datasets.search(users, **a).select(F.lit(k).alias("search"), "name", "username") for k, a in asked.items()])


@query(
    "catalog_refusals",
    """SELECT 'another owner' AS asked, 'LookupError' AS refusal UNION ALL SELECT 'rows of a pending dataset', 'ValueError'
    UNION ALL SELECT 'rows of a failed dataset', 'ValueError' UNION ALL SELECT 'rows of an empty dataset', 'ValueError'
    UNION ALL SELECT 'a deleted dataset', 'LookupError' UNION ALL SELECT 'an empty table', 'ValueError'
    UNION ALL SELECT 'rows of a ready dataset', CAST(count(*) AS VARCHAR) FROM orders""",
)
def _(t):
    datasets, ids = catalog_of(t)
    empty = datasets.register("ann", t.path("orders"), "Empty")
    datasets.save(empty, "ann", t("orders").where("false"))
    datasets.delete(ids["supplier"], "bob")
    asked = {
        "another owner": lambda: datasets.detail(ids["orders"], "bob"),
        "rows of a pending dataset": lambda: datasets.rows(ids["parts"], "ann"),
        "rows of a failed dataset": lambda: datasets.rows(ids["absent"], "ann"),
        "rows of an empty dataset": lambda: datasets.rows(empty, "ann"),
        "a deleted dataset": lambda: datasets.detail(ids["supplier"], "bob"),
        "an empty table": lambda: filters.require_rows(t("orders").where("false")),
        "rows of a ready dataset": lambda: datasets.rows(ids["orders"], "ann"),
    }
    found = []
    for name, ask in asked.items():
        try:
            found.append((name, str(ask().count())))
        except (LookupError, ValueError) as error:
            found.append((name, type(error).__name__))
    return t.spark.createDataFrame(found, "asked string, refusal string")


@query(
    "catalog_saved_rows",
    "SELECT row_index, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, regexp_replace(CAST(c_acctbal * 100000 AS VARCHAR), '\\.0$', '') AS big, '' AS note FROM " + CUSTOMERS,
)
def _(t):
    datasets, _ = catalog_of(t)
    dataset = datasets.register("ann", t.path("customer"))
    table = dense_index(t("customer"), ["c_custkey"]).select("row_index", "c_custkey", "c_name", (F.col("c_acctbal") * 100000).alias("big"), F.lit(None).cast("string").alias("note"))
    datasets.save(dataset, "ann", table)
    return datasets.rows(dataset, "ann")


# -- sheets -------------------------------------------------------------------------------------------


@query(
    "sheet_layouts",
    """SELECT c_mktsegment AS sheet, 2::BIGINT AS header_idx, 'customer_key 0,name 1,acct_balance 3,name_1 4' AS positions FROM customer GROUP BY 1""",
)
def _(t):
    # A sheet of one row and one of a single column are left out.
    short = t("nation").where("n_nationkey = 0").select(F.lit("short").alias("sheet"), F.lit(0).cast("bigint").alias("row_idx"), F.array("n_name", "n_name").alias("cells"))
    narrow = t("nation").select(F.lit("narrow").alias("sheet"), F.col("n_nationkey").cast("bigint").alias("row_idx"), F.array("n_name").alias("cells"))
    grid = sheet_grid(t("customer")).unionByName(short).unionByName(narrow)
    names = {"Customer Key": "customer_key", "Name": "name", "Acct. Balance": "acct_balance", "Name_1": "name_1", "Name.1": "name_1"}
    rows = [(x.sheet, x.header_idx, ",".join(f"{names.get(n, n)} {i}" for n, i in sorted(x.positions.items(), key=lambda p: p[1]))) for x in sheets.sheet_layouts(grid)]
    return t.spark.createDataFrame(rows, "sheet string, header_idx bigint, positions string")


# -- ingest -------------------------------------------------------------------------------------------


@query(
    "ingest_with_bad_file",
    """SELECT 'rows' AS what, CAST(row_number() OVER (ORDER BY event_id) - 1 AS VARCHAR) AS at, CAST(event_id AS VARCHAR) AS value FROM events WHERE event_id % 3 < 2
    UNION ALL SELECT 'ready', '', CAST(count(*) AS VARCHAR) FROM events WHERE event_id % 3 < 2 UNION ALL SELECT 'error', 'true', '0'""",
)
def _(t):
    source, target = scratch_path(t.spark), scratch_path(t.spark)
    events = t("events").select("event_id", "event_type")
    ordered = events.where("event_id % 3 < 2").repartitionByRange(3, "event_id").sortWithinPartitions("event_id")
    ordered.write.json(source)
    events.where("event_id % 3 = 2").select(F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"))).coalesce(1).write.mode("append").text(source)
    ingest_folder(t.spark, source, "event_id bigint, event_type string", target, f"{target}/mark").awaitTermination()
    text = F.col("row_index").cast("string")
    rows = ingested(t.spark, target).select(F.lit("rows").alias("what"), text.alias("at"), F.col("event_id").cast("string").alias("value"))
    status = ingest_status(t.spark, target)
    ready = status.where("status = 'ready'").agg(F.sum("n_rows").cast("string").alias("value")).select(F.lit("ready").alias("what"), F.lit("").alias("at"), "value")
    bad = status.where("status = 'error'").select(F.lit("error").alias("what"), (F.col("error_message") != "").cast("string").alias("at"), F.col("n_rows").cast("string").alias("value"))
    return rows.unionByName(ready).unionByName(bad)


# -- activity log ---------------------------------------------------------------------------------------


@query(
    "activity_log",
    f"""SELECT 1 AS position, 'Trimmed whitespace' AS message, 0::BIGINT AS removed,
      count(*) FILTER ({TRIM.format(c='c_name')} <> c_name) + count(*) FILTER ({TRIM.format(c='c_mktsegment')} <> c_mktsegment) AS changed, TRUE AS timed FROM {MESSY_CUSTOMERS_SQL}
    UNION ALL SELECT 0, concat('Removed ', count(*) - count(DISTINCT (c_nationkey, c_mktsegment)), ' duplicates'), count(*) - count(DISTINCT (c_nationkey, c_mktsegment)), NULL, TRUE FROM customer""",
)
def _(t):
    log = cleaning.ActivityLog()
    trimmed = log.apply(messy_customers(t("customer")), "trim", cleaning.trim_whitespace, cleaning.cells_to_trim)
    trimmed.write.format("noop").mode("overwrite").save()
    pairs = t("customer").select(F.col("c_custkey").alias("row_index"), "c_nationkey", "c_mktsegment")
    once = log.apply(pairs, "remove_duplicates", cleaning.remove_duplicates)
    once.write.format("noop").mode("overwrite").save()
    return log.entries(t.spark).select("position", "message", "removed", "changed", F.col("time").isNotNull().alias("timed"))


# -- large numbers as text --------------------------------------------------------------------------------

BIG = "regexp_replace(CAST(o_totalprice * 1000 AS VARCHAR), '\\.0$', '')"


def big_orders(t) -> DataFrame:
    return t("orders").select("o_orderkey", (F.col("o_totalprice") * 1000).alias("big"), (F.floor(F.col("o_totalprice") / 50000) * 1e7).alias("step"))


@query("search_large_numbers", f"SELECT o_orderkey FROM orders WHERE {BIG} LIKE '%1234%' OR CAST(o_orderkey AS VARCHAR) LIKE '%1234%'")
def _(t):
    return filters.search(big_orders(t).drop("step"), "1234").select("o_orderkey")


@query(
    "value_counts_large_numbers",
    """SELECT row_number() OVER (ORDER BY count(*) DESC, CAST(floor(o_totalprice / 50000) * 10000000 AS VARCHAR)) AS rank,
      CAST(floor(o_totalprice / 50000) * 10000000 AS VARCHAR) AS label, count(*) AS n FROM orders GROUP BY 2 QUALIFY rank <= 10""",
)
def _(t):
    return aggregates.value_counts_top(big_orders(t), "step")


@query("delimited_lines_large_numbers", f"SELECT o_orderkey, concat('\"', o_orderkey, '\",\"', {BIG}, '\"') AS line FROM orders")
def _(t):
    df = big_orders(t)
    return df.select("o_orderkey", writers.delimited_lines(df, ["o_orderkey", "big"]).alias("line"))


@query(
    "cell_formula_large_numbers",
    """SELECT '=SUM(B1,B2)' AS formula, regexp_replace(CAST(round(sum(o_totalprice * 1000), 4) AS VARCHAR), '\\.0$', '') AS result FROM orders WHERE o_orderkey IN (
      SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 2) UNION ALL SELECT '=COUNT(B1,B2,20000000)', '3'""",
)
def _(t):
    table = dense_index(big_orders(t), ["o_orderkey"])
    return reduce(DataFrame.union, [aggregates.cell_formula(table, f) for f in ("=SUM(B1,B2)", "=COUNT(B1,B2,20000000)")])
