"""Roles, date formats and null shares."""

from pyspark.sql import functions as F

from tablewright.operators import profile as prof
from workload.derived import messy_dates, messy_prices


def roles(df, **kw):
    return {c.name: c.role for c in prof.profile(df, **kw).columns}


def test_roles_of_literal_columns(spark):
    rows = [(i, str(i), f"2024-01-{i % 28 + 1:02d}", "x" if i % 2 else "y", None, i % 2 == 0, [i], f"t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b string, c string, d string, e string, f boolean, g array<int>, h string")
    assert roles(df) == {
        "a": "numeric", "b": "numeric", "c": "date", "d": "categorical", "e": "empty", "f": "numeric", "g": "nested", "h": "text",
    }


def test_fifty_distinct_values_are_categorical(spark):
    df = spark.createDataFrame([(f"t{i}",) for i in range(50)], "c string")
    assert roles(df) == {"c": "categorical"}
    df = spark.createDataFrame([(f"t{i}",) for i in range(51)], "c string")
    assert roles(df) == {"c": "text"}


def test_empty_text_counts_in_the_share(spark):
    df = spark.createDataFrame([("1",)] * 7 + [("",)] * 3, "c string")
    assert roles(df) == {"c": "numeric"}
    df = spark.createDataFrame([("1",)] * 6 + [("",)] * 4, "c string")
    assert roles(df) == {"c": "categorical"}


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double")
    found = prof.profile(df)
    assert found.columns[0].n == 1
    assert found.null_pct() == 66.67


def test_price_roles(table):
    assert roles(messy_prices(table("orders")).select("price_txt"))["price_txt"] == "numeric"
    assert roles(messy_prices(table("orders"), 3).select("price_txt"))["price_txt"] != "numeric"
    assert roles(messy_prices(table("orders"), 3).select("price_txt"), money=False)["price_txt"] == "text"


def test_date_shares(table):
    found = prof.profile(messy_dates(table("orders")), order_by=["o_orderkey"])
    by_name = {c.name: c for c in found.columns}
    assert (by_name["d_iso"].role, by_name["d_iso"].date_format) == ("date", "Y-m-d")
    assert (by_name["d_us"].role, by_name["d_us"].date_format) == ("date", "m/d/Y")
    assert by_name["d_mix75"].role == "date"
    assert by_name["d_mix50"].role != "date"


def test_day_first_without_order_key(spark):
    df = spark.createDataFrame([("05/01/2024",), ("13/01/2024",), ("31/12/2024",)], "d string")
    assert prof.profile(df).columns[0].date_format == "d/m/Y"


def test_month_first_by_the_first_value(spark):
    df = spark.createDataFrame([(0, "01/02/2024"), (1, "13/01/2024"), (2, "02/03/2024")], "i int, d string")
    found = prof.profile(df, order_by=["i"]).columns[1]
    assert (found.date_format, found.n_date, found.role) == ("m/d/Y", 2, "date")


def test_coerce_replaces_typed_columns(spark):
    df = spark.createDataFrame([("1", "2024-01-01"), ("2", "2024-01-02"), ("3", "2024-01-03"), ("x", "2024-01-04")], "a string, d string")
    found = prof.profile(df)
    typed = prof.coerce(df, found)
    assert dict(typed.dtypes) == {"a": "double", "d": "timestamp_ntz"}
    assert [r.a for r in typed.orderBy("d").collect()] == [1.0, 2.0, 3.0, None]
    assert found.null_pct() == 12.5


def test_odd_column_names(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "y")], ["a.b", "c `d`"])
    assert roles(df) == {"a.b": "numeric", "c `d`": "categorical"}


def test_role_counts(table):
    counts = {r.role: r.n_cols for r in prof.role_counts(prof.profile_frame(table("orders"))).collect()}
    assert counts == {"numeric": 3, "categorical": 2, "date": 1}


def test_distinct_screen_is_exact_near_the_limit(spark):
    for distinct, role in ((300, "categorical"), (301, "text")):
        df = spark.range(1000).select(F.concat(F.lit("v"), F.least("id", F.lit(distinct - 1)).cast("string")).alias("c"))
        assert roles(df) == {"c": role}
