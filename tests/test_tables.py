"""Row index, edits, cleaning, filters and ordering on small tables."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators import cleaning, columns, deletions, edits, filters, ordering
from tablewright.operators.rowindex import dense_index, file_index, running_total


@pytest.fixture
def people(spark):
    rows = [(i, f"n{i}", float(i * 10), None if i == 3 else "x") for i in range(10)]
    return spark.createDataFrame(rows, "row_index bigint, name string, pay double, tag string").repartition(4)


def test_dense_index_with_a_hot_value(spark):
    rows = [(random.Random(i).choice([7, 7, 7, i]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, i int").repartition(7)
    got = [(r.k, r.i) for r in dense_index(df, ["k", "i"]).orderBy("row_index").collect()]
    assert got == sorted(rows)
    assert [r[0] for r in dense_index(df, ["k", "i"]).orderBy("row_index").select("row_index").collect()] == list(range(3000))


def test_dense_index_descending_and_unordered(spark):
    df = spark.range(100).repartition(5)
    down = dense_index(df, [F.desc("id")]).collect()
    assert all(r.row_index == 99 - r.id for r in down)
    assert sorted(r.row_index for r in dense_index(df).collect()) == list(range(100))


def test_dense_index_of_nothing(spark):
    assert dense_index(spark.range(0), ["id"]).collect() == []


def test_dense_index_with_an_untyped_column(spark):
    df = spark.range(10).withColumn("none", F.lit(None))
    assert [r.row_index for r in dense_index(df, ["id"]).orderBy("id").collect()] == list(range(10))


def test_running_total(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7).repartition(6)
    got = running_total(df, ["id"], "v", "total").orderBy("id").collect()
    total = 0
    for r in got:
        total += r.v
        assert r.total == total


def test_file_index_over_several_files(spark, tmp_path):
    spark.range(1000).repartition(5).write.parquet(str(tmp_path / "t"))
    got = file_index(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert sorted(r.row_index for r in got) == list(range(1000))


def test_update_cell(people):
    got = {r.row_index: r.pay for r in edits.update_cell(people, 2, "pay", 99).collect()}
    assert got[2] == 99.0 and got[3] == 30.0
    with pytest.raises(ValueError, match="row 50"):
        edits.update_cell(people, 50, "pay", 1)
    with pytest.raises(ValueError, match="column"):
        edits.update_cell(people, 1, "none", 1)


def test_update_cells_last_edit_wins_and_null_clears(spark, people):
    changes = spark.createDataFrame(
        [(1, "name", "a", 0), (1, "name", "b", 1), (2, "tag", None, 0), (2, "pay", "7.5", 0), (40, "pay", "1", 0), (3, "no", "1", 0)],
        "row_index bigint, column string, value string, edit_no int",
    )
    got = {r.row_index: r for r in edits.update_cells(people, changes).collect()}
    assert len(got) == 10
    assert got[1].name == "b" and got[2].tag is None and got[2].pay == 7.5 and got[3].name == "n3"


def test_append_rows(people):
    got = edits.append_rows(people, [{"name": "new", "ghost": 1}, {"pay": 2.5}]).orderBy("row_index").collect()
    assert [r.row_index for r in got] == list(range(12))
    assert (got[10].name, got[10].pay, got[10].tag) == ("new", None, "")
    assert (got[11].name, got[11].pay) == ("", 2.5)


@pytest.mark.parametrize("gone", [[0], [9], [3, 4, 8], list(range(0, 10, 2))])
def test_delete_rows_keeps_the_index_dense(people, gone):
    got = edits.delete_rows(people, gone).orderBy("row_index").collect()
    assert [r.row_index for r in got] == list(range(10 - len(gone)))
    assert [r.name for r in got] == [f"n{i}" for i in range(10) if i not in gone]


@pytest.mark.parametrize("n", [64, 65, 5000])
def test_delete_rows_of_an_index_with_gaps(spark, monkeypatch, n):
    kept = [i for i in range(300_000) if i % 7]
    df = spark.createDataFrame([(i, str(i)) for i in kept[::3]], "row_index bigint, v string").repartition(5)
    gone = random.Random(n).sample(range(300_000), n) + [299_999, 0, 65_535, 65_536]
    ordered = sorted(set(gone))
    want = sorted((i - bisect.bisect_left(ordered, i), str(i)) for i in set(kept[::3]) - set(gone))
    for rows in (gone, spark.createDataFrame([(g,) for g in [*gone, gone[0], None]], "row_index bigint")):
        assert sorted((r.row_index, r.v) for r in edits.delete_rows(df, rows).collect()) == want
    monkeypatch.setattr(deletions, "BROADCAST_REMOVALS", 0)
    assert sorted((r.row_index, r.v) for r in edits.delete_rows(df, gone).collect()) == want


def test_delete_no_rows(spark, people):
    assert edits.delete_rows(people, []).count() == 10
    assert edits.delete_rows(people, spark.createDataFrame([], "row_index bigint")).count() == 10
    assert edits.delete_rows(people.where("false"), list(range(100))).count() == 0


def test_rejected_edits(spark, people):
    changes = spark.createDataFrame(
        [(1, "pay", "abc", 1), (1, "pay", "7", 0), (99, "pay", "1", 0), (2, "nosuch", "x", 0), (None, "pay", "1", 0), (3, None, "1", 0), (4, "pay", None, 0), (5, "row_index", "1", 0)],
        "row_index bigint, column string, value string, edit_no int",
    )
    got = {(r.row_index, r.column): r.reason for r in edits.rejected_edits(people, changes).collect()}
    assert got == {(1, "pay"): "bad value", (99, "pay"): "unknown row", (2, "nosuch"): "unknown column", (None, "pay"): "no row", (3, None): "unknown column", (5, "row_index"): "unknown column"}
    table = {r.row_index: r.pay for r in edits.update_cells(people, changes).collect()}
    assert table[1] == 7.0 and table[4] is None and table[5] == 50.0 and len(table) == 10
    nested = people.withColumn("list", F.array("name"))
    odd = spark.createDataFrame([(0, "list", "x"), (1, "list", None)], "row_index bigint, column string, value string")
    assert {r.row_index: r["list"] for r in edits.update_cells(nested, odd).collect()}[1] is None
    assert [(r.row_index, r.reason) for r in edits.rejected_edits(nested, odd).collect()] == [(0, "bad value")]


def test_append_checks_its_values(people):
    with pytest.raises(ValueError, match="'lots' is no value of column 'pay'"):
        edits.append_rows(people, [{"pay": "lots"}])


def test_delete_many_rows(spark):
    df = spark.range(500).select(F.col("id").alias("row_index"), F.col("id").alias("v"))
    got = edits.delete_rows(df, list(range(0, 400, 2))).orderBy("row_index").collect()
    assert [r.row_index for r in got] == list(range(300))
    assert [r.v for r in got] == [i for i in range(500) if i >= 400 or i % 2]


def test_trim_and_fill(spark):
    df = spark.createDataFrame([(" a\t", None, 1), ("\n", " ", None), ("b", "c", 3)], "x string, y string, z int")
    once = cleaning.trim_whitespace(df)
    assert [tuple(r) for r in once.collect()] == [("a", None, 1), ("", "", None), ("b", "c", 3)]
    assert cleaning.trim_whitespace(once).collect() == once.collect()
    filled = cleaning.fill_empty(df).collect()
    assert [tuple(r) for r in filled] == [("a", "0", 1), ("0", "0", 0), ("b", "c", 3)]


def test_remove_duplicates_keeps_the_first(spark):
    rows = [(5, "a", 1), (2, "a", 1), (9, None, 1), (4, None, 1), (7, "b", 2)] + [(100 + i, "hot", 0) for i in range(500)]
    df = spark.createDataFrame(rows, "row_index bigint, x string, y int").repartition(5)
    once = cleaning.remove_duplicates(df)
    assert sorted((r.row_index, r.x, r.y) for r in once.collect()) == [(2, "a", 1), (4, None, 1), (7, "b", 2), (100, "hot", 0)]
    assert cleaning.remove_duplicates(once).count() == 4


def test_remove_duplicates_with_maps(spark):
    df = spark.sql("select * from values (1L, map('a', 1), 'x'), (0L, map('a', 1), 'x'), (2L, map('b', 1), 'x') t(row_index, m, s)")
    got = sorted(((r.row_index, r.m, r.s) for r in cleaning.remove_duplicates(df).collect()), key=lambda r: r[0])
    assert got == [(0, {"a": 1}, "x"), (2, {"b": 1}, "x")]


def test_activity_log(spark):
    df = spark.createDataFrame([(0, " a"), (1, "a"), (2, "a"), (3, None)], "row_index bigint, x string")
    log = cleaning.ActivityLog()
    out = log.apply(df, "trim", cleaning.trim_whitespace, cleaning.cells_to_trim)
    out = log.apply(out, "fill", cleaning.fill_empty, cleaning.cells_to_fill)
    out = log.apply(out, "remove duplicates", cleaning.remove_duplicates)
    assert len(out.collect()) == 2
    assert [tuple(r) for r in log.frame(spark).orderBy("step").collect()] == [
        (0, "trim", 4, 4, 1), (1, "fill", 4, 4, 1), (2, "remove duplicates", 4, 2, None),
    ]


def test_search(people):
    assert {r.row_index for r in filters.search(people, "N3").collect()} == {3}
    assert filters.search(people, "").count() == 10
    assert {r.row_index for r in filters.search(people, "90.0").collect()} == {9}


def test_complete_cases_and_guard(spark, people):
    assert filters.complete_cases(people, ["name", "tag"]).count() == 9
    with pytest.raises(ValueError):
        filters.require_rows(people.limit(0))


def test_mixed_sort(spark):
    df = spark.createDataFrame(list(enumerate(["b", "10", "9kg", None, "A", ""])), "row_index int, c string")
    up = [r.c for r in ordering.sort_rows(df, "c").collect()]
    assert up == ["9kg", "10", "", "A", "b", None]
    down = [r.c for r in ordering.sort_rows(df, "c", ascending=False).collect()]
    assert down == ["10", "9kg", "b", "A", "", None]


def test_pages(people):
    assert [r.row_index for r in ordering.page(people, 2, 4).orderBy("row_index").collect()] == [4, 5, 6, 7]
    info = ordering.page_info(people, 3, 4).first()
    assert (info["count"], info["next"], info["previous"]) == (10, None, 2)
    assert ordering.page_info(people, 1, 4).first()["next"] == 2
    with pytest.raises(ValueError):
        ordering.page(people, 0)
    with pytest.raises(ValueError):
        ordering.page(people, 1, 1000)


def test_page_filter_reaches_the_scan(spark, people, tmp_path):
    people.write.parquet(str(tmp_path / "p"))
    plan = ordering.page(spark.read.parquet(str(tmp_path / "p")), 2, 4)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(row_index,4)" in plan and "LessThan(row_index,8)" in plan


def test_top_rows_missing_last(spark):
    df = spark.createDataFrame([(0, 1.0, "a"), (1, None, "b"), (2, 3.0, None)], "row_index int, v double, s string")
    got = [tuple(r) for r in ordering.top_rows(df, "v", ["s", "v"], ["row_index"]).orderBy("rank").collect()]
    assert got == [(1, "", 3.0), (2, "a", 1.0), (3, "b", None)]


def test_stride(spark):
    df = spark.range(151).select(F.col("id").alias("row_index"))
    assert ordering.stride(df).count() == 76
    assert ordering.stride(df.where("row_index < 150")).count() == 150


def test_columns(spark, people):
    assert columns.add_column(people).columns[-1] == "Column_4"
    with pytest.raises(ValueError, match="exists"):
        columns.add_column(people, "pay")
    assert columns.uppercase_columns(people).columns == ["ROW_INDEX", "NAME", "PAY", "TAG"]
    got = {r.row_index: r.total for r in columns.function_to_column(people, "SUM", "pay", "total").collect()}
    assert got[9] == "450.0" and set(got[i] for i in range(9)) == {""}
    got = {r.row_index: r.name for r in columns.write_scalar(people, 5, "name").collect()}
    assert got[9] == "5" and got[0] == "n0"


def test_transform(people):
    got = columns.transform(people, step=lambda df: df.where("pay > 50"), exprs={"half": "pay / 2"})
    assert sorted(r.half for r in got.collect()) == [30.0, 35.0, 40.0, 45.0]
