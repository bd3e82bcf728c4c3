"""The stored table with fences: pages by pushdown, edits laid over it, sorted views and compaction."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright.sources.indexed import ID, IndexedTable


@pytest.fixture
def stored_rows(spark, tmp_path):
    df = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 7 % 13).cast("double").alias("v"), F.concat(F.lit("t"), "id").alias("s"))
    return IndexedTable.create(df.repartition(5), str(tmp_path / "table"), ["k"], rows_per_file=150)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def files_read(df):
    return len(df.inputFiles())


def test_pages_are_filtered_in_the_scan(spark, stored_rows):
    page = stored_rows.page(3, 100)
    assert [r.k for r in page.orderBy("row_index").collect()] == list(range(200, 300))
    text = plan_of(page)
    assert f"GreaterThanOrEqual({ID},200)" in text and "Exchange" not in text
    assert files_read(page) < stored_rows.fences().count()
    points = stored_rows.stride()
    assert sorted(r.row_index for r in points.collect()) == list(range(0, 2000, 20))
    pushed = plan_of(points).split("PushedFilters: ")[1]
    assert f"LessThanOrEqual({ID},1980), Or(" in pushed and "Exchange" not in plan_of(points)
    with pytest.raises(ValueError):
        stored_rows.page(0)
    with pytest.raises(ValueError):
        stored_rows.page(1, 501)


def test_edits_match_a_list(spark, stored_rows):
    rng = random.Random(8)
    want = [[k, float(k * 7 % 13), f"t{k}"] for k in range(2000)]
    for step in range(3):
        gone = rng.sample(range(len(want)), 150) + [5000 + step]
        stored_rows.delete(gone)
        want = [r for i, r in enumerate(want) if i not in set(gone)]
        changed = [(i, "s", f"e{step}{i}") for i in rng.sample(range(len(want)), 80)]
        asked = [*changed, (3, "v", "wrong"), (99_999, "s", "x"), (4, "none", "x")]
        rejected = stored_rows.update(spark.createDataFrame(asked, "row_index bigint, column string, value string"))
        assert sorted((r.row_index, r.reason) for r in rejected.collect()) == [(3, "bad value"), (4, "unknown column"), (99_999, "unknown row")]
        for i, _, value in changed:
            want[i][2] = value
        stored_rows.append([{"k": -step, "s": "new"}])
        want.append([-step, None, "new"])
        got = [[r.k, r.v, r.s] for r in stored_rows.rows().orderBy("row_index").collect()]
        assert got == want and stored_rows.count() == len(want)
        assert [r.row_index for r in stored_rows.rows().orderBy("row_index").collect()] == list(range(len(want)))
        for start in (0, 37, 700, len(want) - 5):
            assert [r.k for r in stored_rows.viewport(start, start + 50).orderBy("row_index").collect()] == [r[0] for r in want[start : start + 50]]
    stored_rows.compact()
    assert [[r.k, r.v, r.s] for r in stored_rows.rows().orderBy("row_index").collect()] == want
    assert stored_rows.count() == len(want)
    assert [r.row_index for r in stored_rows.stride().orderBy("row_index").collect()] == list(range(0, len(want), -(-len(want) // 100)))


def test_sorted_pages(stored_rows):
    ordered = sorted(range(2000), key=lambda k: (-(k * 7 % 13), k))
    for _ in range(2):  # stored, then read again
        got = stored_rows.sorted_page("v", 2, 50, ascending=False).orderBy("position").collect()
        assert [r.position for r in got] == list(range(50, 100))
        assert [r.k for r in got] == ordered[50:100]
    stored_rows.delete([ordered[0]])
    got = stored_rows.sorted_page("v", 1, 10, ascending=False).orderBy("position").collect()
    assert [r.k for r in got] == ordered[1:11]


def test_small_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(2, "c"), (0, "a"), (1, "b")], "row_index bigint, s string")
    small = IndexedTable.create(df, str(tmp_path / "small"))
    assert [r.s for r in small.rows().orderBy("row_index").collect()] == ["a", "b", "c"]
    assert small.stride().count() == 3 and small.page(2, 2).first().s == "c" and small.page(9).count() == 0
    small.delete([0, 1, 2])
    assert small.count() == 0 and small.rows().count() == 0 and small.page().count() == 0
    small.append([{"s": "d"}])
    assert [(r.row_index, r.s) for r in small.rows().collect()] == [(0, "d")]
    none = IndexedTable.create(df.where("false"), str(tmp_path / "none"))
    assert none.count() == 0 and none.page().count() == 0 and none.stride().count() == 0
    none.append([{"s": "a"}])
    assert none.page().first().s == "a"
