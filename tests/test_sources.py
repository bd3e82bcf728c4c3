"""Readers, sheets, writers, catalog and incremental ingest."""

import csv
import io
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.sources import delimited, readers, sheets, writers
from tablewright.sources.catalog import Catalog, with_owner
from tablewright.sources.order import placed, source_index
from tablewright.streaming.ingest import ingest_folder, ingest_status, ingested


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows_of(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_dispatch(spark, tmp_path):
    spark.range(3).toDF("My Id").write.parquet(str(tmp_path / "t.parquet"))
    assert readers.read_table(spark, str(tmp_path / "t.parquet")).columns == ["my_id"]
    spark.range(3).write.orc(str(tmp_path / "t.orc"))
    assert readers.read_table(spark, str(tmp_path / "t.orc")).count() == 3
    lines = write(tmp_path / "t.JSONL", '{"A b": 1}\n{"A b": 2, "c": "x"}\n')
    assert sorted(readers.read_table(spark, lines).columns) == ["a_b", "c"]
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_table(spark, "book.xlsx")
    with pytest.raises(ValueError, match="failed"):
        readers.read_table(spark, str(tmp_path / "absent.parquet"))


def test_csv(spark, tmp_path):
    path = write(tmp_path / "t.csv", 'A,A,"b, c",Unnamed: 3\n1,2,"x ""y""",4\n3,oops,z,\n')
    df = readers.read_table(spark, path)
    assert df.dtypes == [("a", "double"), ("a_1", "string"), ("b_c", "string"), ("col_3", "double")]
    assert rows_of(df, "a") == [(1.0, "2", 'x "y"', 4.0), (3.0, "oops", "z", None)]


def test_json_records(spark, tmp_path):
    path = write(tmp_path / "t.json", json.dumps([{"a": 1, "b": [1, [2]]}, {"a": 2, "c": "x"}]))
    df = readers.read_table(spark, path)
    assert sorted(df.columns) == ["a", "b", "c"] and df.count() == 2
    with pytest.raises(ValueError):
        readers.read_table(spark, write(tmp_path / "e.json", "[]"))
    with pytest.raises(ValueError):
        readers.read_table(spark, write(tmp_path / "n.json", "42"))


@pytest.mark.parametrize(
    "doc, orient",
    [
        ({"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": "y"}}, None),
        ({"a": [1, 2], "b": ["x", "y"]}, None),
        ({"r0": {"a": 1, "b": "x"}, "r1": {"a": 2, "b": "y"}}, "index"),
        ({"columns": ["a", "b"], "index": [0, 1], "data": [[1, "x"], [2, "y"]]}, "split"),
        ({"columns": ["a", "b"], "index": [0, 1, 2], "data": [[1, "x"], [2, "y"]]}, None),
        ({"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": "y"}}, "columns"),
    ],
)
def test_json_layouts(spark, tmp_path, doc, orient):
    path = write(tmp_path / "t.json", json.dumps(doc))
    df = readers.read_json(spark, path, orient)
    assert df.dtypes == [("a", "bigint"), ("b", "string")]
    assert rows_of(df, "a") == [(1, "x"), (2, "y")]
    assert rows_of(readers.read_json(spark, path, orient, typed=False), "a") == [("1", "x"), ("2", "y")]


def test_json_values(spark, tmp_path):
    path = write(tmp_path / "t.json", "[[1, 2], [3, [4]]]")
    assert rows_of(readers.read_json(spark, path, "values"), "0") == [(1, "2"), (3, "[4]")]


@pytest.mark.parametrize(
    "orient, docs",
    [
        ("records", [[{"zone": "n", "qty": 1, "amount": 2.5}, {"late": True, "qty": 2}], [{"qty": 3, "early": 0}]]),
        ("index", [{"r9": {"zone": "n", "qty": 1, "amount": 2.5}, "r1": {"late": True, "qty": 2}}, {"r0": {"qty": 3, "early": 0}}]),
        ("split", [{"columns": ["zone", "qty", "amount"], "index": [0], "data": [["n", 1, 2.5]]}, {"columns": ["late", "qty", "early"], "index": [0, 1], "data": [[True, 2, None], [None, 3, 0]]}]),
        ("columns", [{"zone": {"7": "n"}, "qty": {"7": 1, "3": 2}, "amount": {"7": 2.5}, "late": {"3": True}}, {"qty": {"0": 3}, "early": {"0": 0}}]),
        ("lists", [{"zone": ["n", None], "qty": [1, 2], "amount": [2.5, None], "late": [None, True]}, {"qty": [3], "early": [0]}]),
    ],
)
def test_json_order_of_names_and_rows(spark, tmp_path, orient, docs):
    for name, doc in zip("ab", docs):
        write(tmp_path / f"{name}.json", json.dumps(doc))
    table, in_place = readers.read_source(spark, str(tmp_path / "*.json"), "json", **({} if orient == "lists" else {"orient": orient}))
    df = source_index(table, in_place)
    assert df.columns == ["row_index", "zone", "qty", "amount", "late", "early"]
    assert rows_of(df, "row_index") == [(0, "n", 1, 2.5, None, None), (1, None, 2, None, True, None), (2, None, 3, None, None, 0)]


def test_json_values_of_many_columns(spark, tmp_path):
    path = write(tmp_path / "t.json", json.dumps([list(range(12)), list(range(12, 24))]))
    df = readers.read_json(spark, path, "values")
    assert df.columns == [str(i) for i in range(12)]
    assert rows_of(df, "0") == [tuple(range(12)), tuple(range(12, 24))]


def test_json_names_that_clash(spark, tmp_path):
    path = write(tmp_path / "t.json", '[{"_file": 1, "_place": "x", "a.b": 2, "c0": 3}]')
    assert readers.read_table(spark, path).columns == ["file", "place", "a_b", "c0"]
    assert readers.read_json(spark, path).columns == ["_file", "_place", "a.b", "c0"]


@pytest.mark.parametrize("text", ['[{"a": 1}, {"b":', '{"a": [1, 2', '[{"a": 1}] tail', '{"a": {"0": 1}, "b": {"0" 2}}', '[{"a": 1}, 3]', "x"])
def test_malformed_json_is_an_error(spark, tmp_path, text):
    with pytest.raises(ValueError):
        readers.read_table(spark, write(tmp_path / "t.json", text))


def test_json_lines(spark, tmp_path):
    path = write(tmp_path / "t.jsonl", '{"z": 1, "a": "x"}\n\n{"m": [2], "a": "y"}\n')
    df, in_place = readers.read_source(spark, path)
    assert rows_of(source_index(df, in_place).select("row_index", "z", "a"), "row_index") == [(0, 1, "x"), (1, None, "y")]
    assert readers.read_table(spark, path).columns == ["z", "a", "m"]
    with pytest.raises(ValueError, match="failed"):
        readers.read_table(spark, write(tmp_path / "bad.jsonl", '{"z": 1}\n{"z": \n'))


CELLS = ["", "plain", "a,b", "x\ny", 'he said "hi"', "line1\n\nline3,\"q\"", '5" pipe', "é😀", "w " * 40, "\n", '"', "a\r\nb"]


def csv_files(folder, n_files=3, n_rows=150, seed=3):
    """Files of rows with every kind of cell, in both line endings; and their rows in the order of the files."""
    rng, want = random.Random(seed), {}
    for name in rng.sample("abcdef", n_files):
        rows = [[str(i), *[rng.choice(CELLS) for _ in range(rng.choice([3, 3, 3, 2, 5]))]] for i in range(n_rows)]
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\r\n" if name in "ace" else "\n")
        writer.writerows([["id", "A b", "c", "d"], *rows])
        (folder / f"{name}.csv").write_bytes((out.getvalue() + ('7,6" x,8" y,z\n\n' if name in "ab" else "")).encode())
        want[name] = rows + ([["7", '6" x', '8" y', "z"]] if name in "ab" else [])
    return [tuple(c or None for c in [*r, *[""] * (6 - len(r))]) for name in sorted(want) for r in want[name]]


@pytest.fixture
def block_bytes(spark):
    """Sets the size of the blocks that files are read in."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield use
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", ["128m", "4k", "200"])
def test_csv_line_breaks_in_any_blocks(spark, tmp_path, block_bytes, size):
    want = csv_files(tmp_path)
    block_bytes(size)
    df = source_index(delimited.delimited_table(spark, str(tmp_path)))
    assert df.columns == ["row_index", "id", "a_b", "c", "d", "col_4", "col_5"]
    assert rows_of(df, "row_index") == [(i, *r) for i, r in enumerate(want)]


def test_csv_cell_longer_than_blocks(spark, tmp_path, block_bytes):
    long = "\n".join(f"line {i}, of one cell" for i in range(400))
    write(tmp_path / "t.csv", f'k,v\n1,"{long}"\n2,b\n3,"{long}"\n')
    block_bytes("500")
    assert rows_of(readers.read_csv(spark, str(tmp_path), typed=False), "k") == [("1", long), ("2", "b"), ("3", long)]


def test_csv_starts_that_do_not_fit_in_a_broadcast(spark, tmp_path, block_bytes, monkeypatch):
    want = csv_files(tmp_path)
    block_bytes("300")
    monkeypatch.setattr(delimited, "broadcast_if_small", lambda df: df)
    assert rows_of(source_index(delimited.delimited_table(spark, str(tmp_path))), "row_index") == [(i, *r) for i, r in enumerate(want)]


def test_csv_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="never closes"):
        readers.read_csv(spark, write(tmp_path / "open.csv", 'a,b\n1,"x\n2,y\n'))
    with pytest.raises(ValueError, match="empty"):
        readers.read_csv(spark, write(tmp_path / "empty.csv", "\n \n"))
    folder = tmp_path / "two"
    folder.mkdir()
    write(folder / "a.csv", "a,b\n1,2\n")
    write(folder / "b.csv", "b,a\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        readers.read_csv(spark, str(folder))
    assert readers.read_csv(spark, write(tmp_path / "bare.csv", "\ufeffa,b\n")).count() == 0
    assert readers.read_csv(spark, write(tmp_path / "bom.csv", "\ufeff\"a\",b\n1,2\n")).columns == ["a", "b"]


def test_cells(values):
    lines = ["", ",", 'a,"b ""c"", d",e', '"x"y,"",z', '5" a,6" b', '"open, a', "a;b", None]
    assert values(lines, delimited.cells) == [[None], [None, None], ["a", 'b "c", d', "e"], ["xy", None, "z"], ['5" a', '6" b'], ["open, a"], ["a;b"], None]
    assert values(["a|b|\"c|d\"", "a.b"], lambda c: delimited.cells(c, "|")) == [["a", "b", "c|d"], ["a.b"]]


def test_source_order_of_uneven_files(spark, tmp_path):
    for k, n in enumerate([3, 400, 1, 90]):
        spark.range(n).select((F.col("id") + 1000 * k).alias("v")).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
    scan = spark.read.parquet(*[str(tmp_path / f"p{k}") for k in range(4)])
    df = source_index(placed(scan))
    assert [r.v for r in df.orderBy("row_index").collect()] == [1000 * k + i for k, n in enumerate([3, 400, 1, 90]) for i in range(n)]
    assert [r.row_index for r in df.orderBy("row_index").collect()] == list(range(494))


def test_equal_documents_stay_apart(spark):
    df = spark.createDataFrame([('[{"a": 1}]',)] * 5 + [('{"a": {"0": 1}}',)] * 0, "doc string")
    assert readers.from_documents(df, "doc", "records").count() == 5
    df = spark.createDataFrame([('{"a": {"0": 1}, "b": {"0": 2}}',)] * 5, "doc string")
    assert rows_of(readers.from_documents(df, "doc", "columns")) == [("1", "2")] * 5


def test_rows_to_table(spark):
    df = spark.createDataFrame([(0, '{"a": 1, "z": 2}'), (1, '{"b": {"n": [1]}}'), (2, "bad")], "row_index bigint, data string")
    assert rows_of(readers.rows_to_table(df, ["a", "b"]), "row_index") == [(0, "1", None), (1, None, '{"n":[1]}'), (2, None, None)]


def test_row_documents(spark):
    df = spark.sql(
        "select 0L as row_index, timestamp_ntz'2024-01-02 03:04:05' as t, cast('nan' as double) as v, "
        "0.123456789012D as w, cast(null as string) as s, array(1, 2) as l"
    )
    doc = json.loads(writers.row_documents(df).first().data)
    assert doc == {"t": "2024-01-02T03:04:05.000", "v": None, "w": 0.123456789, "s": None, "l": [1, 2]}
    with pytest.raises(ValueError):
        writers.row_documents(df.select("row_index", "v", F.col("w").alias("v")))


def test_delimited(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b', None), (2, "c,d", "e")], "i int, x string, y string")
    lines = [r[0] for r in df.orderBy("i").select(writers.delimited_lines(df, ["x", "y"])).collect()]
    assert lines == ['"a""b",""', '"c,d","e"']
    assert writers.header_line(["x", "y"]) == "x,y"
    out = str(tmp_path / "out")
    writers.write_delimited(df, out, ["y", "i"])
    back = spark.read.csv(out, header=True, escape='"')
    assert back.columns == ["y", "i"] and back.count() == 2


def test_load_indexed(spark, tmp_path):
    df = spark.range(100).select((F.lit(99) - F.col("id")).alias("k")).repartition(4)
    back = writers.load_indexed(df, str(tmp_path / "t"), ["k"])
    assert rows_of(back.select("row_index", "k"), "k") == [(i, i) for i in range(100)]


GRID = "sheet string, row_idx bigint, cells array<string>"


def grid(spark, **by_name):
    rows = [(s, i, cells) for s, lines in by_name.items() for i, cells in enumerate(lines)]
    return spark.createDataFrame(rows, GRID).repartition(3)


GOOD = [
    ["Report", None, None, None],
    [None, None, None, None],
    ["Name", "Qty", "Price", "Void"],
    ["ann", "1", "2.5", None],
    [None, None, None, None],
    ["bob", "2", "n/a", None],
]


def test_one_valid_sheet_loses_its_tag(spark):
    df = sheets.normalise(grid(spark, main=GOOD, narrow=[["only"], ["1"]], tiny=[["a", "b"]]))
    assert df.dtypes == [("row_idx", "bigint"), ("name", "string"), ("qty", "double"), ("price", "string")]
    assert rows_of(df, "row_idx") == [(3, "ann", 1.0, "2.5"), (5, "bob", 2.0, "n/a")]


def test_sheets_are_united_by_name(spark):
    other = [["Qty", "Extra"], ["x1", "9"], ["7", "8"]]
    df = sheets.normalise(grid(spark, a=GOOD, b=other))
    assert df.columns == ["sheet", "row_idx", "name", "qty", "price", "extra"]
    assert dict(df.dtypes)["qty"] == "string" and dict(df.dtypes)["extra"] == "double"
    assert rows_of(df.where("sheet = 'b'"), "row_idx") == [("b", 1, None, "x1", None, 9.0), ("b", 2, None, "7", None, 8.0)]


def test_headers_are_matched_as_written_then_cleaned(spark):
    a = [["Qty", "qty ", None, "Qty"], ["1", "2", "3", "4"]]
    b = [["Qty", "Other", None, None], ["5", "6", "7", None]]
    df = sheets.normalise(grid(spark, a=a, b=b))
    assert df.columns == ["sheet", "row_idx", "qty", "qty_1", "col_3", "qty_1_1", "other"]
    assert rows_of(df, "sheet") == [("a", 1, 1.0, 2.0, 3.0, 4.0, None), ("b", 1, 5.0, None, 7.0, None, 6.0)]


def test_leading_blank_rows_do_not_shift_the_header(spark):
    lines = [[None, None], [None, None], ["A", "B"], ["1", "2"]]
    assert rows_of(sheets.normalise(grid(spark, s=lines))) == [(3, 1.0, 2.0)]


def test_header_falls_back_to_the_first_row(spark):
    lines = [["1", "2"], ["3", "4"], ["5", "6"]]
    df = sheets.normalise(grid(spark, s=lines))
    assert df.columns == ["row_idx", "1", "2"] and df.count() == 2


def test_header_far_from_the_start(spark):
    lines = [[None, None]] * 1200 + [["A", "B"], ["1", "2"]] * 1
    assert [r.header_idx for r in sheets.header_rows(grid(spark, s=lines)).collect()] == [1200]


def test_no_usable_sheet(spark):
    with pytest.raises(ValueError, match="no usable"):
        sheets.normalise(grid(spark, s=[["a"], ["1"]]))


def test_label_rule(values):
    got = values(["Name", " ", "12", "1e5", "nan", "x" * 81, None, "inf", "1_000", "1,000", "$5"], sheets.is_label)
    assert got == [True, False, False, False, False, False, False, False, False, True, True]


def test_text_grid(spark):
    df = spark.createDataFrame([("s", 0, "a,,c")], "s string, i int, line string")
    assert sheets.text_grid(df, F.col("s"), F.col("i"), F.col("line")).first().cells == ["a", None, "c"]


def test_tagged_union(spark):
    a, b = spark.sql("select 1 as x, 'p' as y"), spark.sql("select 'q' as x, 2 as z")
    got = sheets.tagged_union({"a": a, "b": b})
    assert got.columns == ["_sheet", "x", "y", "z"]
    assert rows_of(got, "_sheet") == [("a", "1", "p", None), ("b", "q", None, 2)]
    assert sheets.tagged_union({"a": a}).columns == ["x", "y"]


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "catalog"))


def test_catalog_life(spark, catalog, tmp_path):
    path = write(tmp_path / "sales.csv", "Name,Pay\nann,1\nbob,2\n")
    first = catalog.register("u1", path)
    second = catalog.register("u1", path, "Second")
    assert catalog.detail(first, "u1").status == "pending"
    with pytest.raises(ValueError, match="not ready"):
        catalog.rows(first, "u1")
    done = catalog.ingest(first, "u1", order_by=["name"])
    assert (done.status, done.row_count, done["columns"], done.col_count) == ("ready", 2, ["name", "pay"], 2)
    assert rows_of(catalog.rows(first, "u1").select("row_index", "name"), "row_index") == [(0, "ann"), (1, "bob")]
    assert [r.name for r in catalog.list("u1").collect()] == ["Second", "sales.csv"]
    with pytest.raises(LookupError):
        catalog.detail(first, "u2")
    assert catalog.list("u2").count() == 0

    edited = catalog.rows(first, "u1").withColumn("note", F.lit(None).cast("string"))
    saved = catalog.save(first, "u1", edited)
    assert saved["columns"] == ["name", "pay", "note"]
    assert {r.note for r in catalog.rows(first, "u1").collect()} == {""}

    users = spark.createDataFrame([("u1", "Asha")], "owner_id string, username string")
    assert catalog.search(users, "ASH").count() == 2
    assert catalog.search(users, "second").count() == 1
    assert catalog.search(users, status="ready").count() == 1
    assert catalog.search(users, file_type="json").count() == 0

    catalog.delete(first, "u1")
    assert [r.dataset_id for r in catalog.list("u1").collect()] == [second]
    assert not (tmp_path / "catalog" / "rows" / first).exists()


def test_many_changes_leave_few_files(spark, tmp_path):
    path = write(tmp_path / "sales.csv", "Name\nann\n")
    catalog = Catalog(spark, str(tmp_path / "many"), compact_at=3)
    ids = [catalog.register("u1", path, f"set {i}") for i in range(3)]
    catalog.delete(ids[0], "u1")  # after the first snapshot; the next must remember the deletion
    most = 0
    for i in range(8):
        record = catalog.detail(ids[1 + i % 2], "u1")
        catalog._change(record, error_message=f"change {i}")
        most = max(most, len(catalog._record_files()) + len(catalog._snapshots()))
    assert most <= 2 * 3 + 3
    latest = {r.dataset_id: r.error_message for r in catalog.list("u1").collect()}
    assert latest == {ids[1]: "change 6", ids[2]: "change 7"}

    # A snapshot that was not finished is not read, and folding twice changes nothing.
    (tmp_path / "many" / "snapshots" / "broken").mkdir()
    (tmp_path / "many" / "snapshots" / "broken" / "part-0.parquet").write_bytes(b"PAR1")
    catalog.compact()
    catalog.compact()
    assert {r.dataset_id: r.error_message for r in Catalog(spark, str(tmp_path / "many")).list("u1").collect()} == latest


def test_vacuum_removes_unnamed_versions(spark, catalog, tmp_path):
    assert catalog.vacuum(0) == []
    first = catalog.register("u1", write(tmp_path / "sales.csv", "Name,Pay\nann,1\nbob,2\n"))
    catalog.ingest(first, "u1", order_by=["name"])
    before = catalog.detail(first, "u1").version
    catalog.save(first, "u1", catalog.rows(first, "u1"))
    assert catalog.vacuum() == []  # too young
    removed = catalog.vacuum(0)
    assert [r.rsplit("/", 1)[-1] for r in removed] == [before]
    assert catalog.rows(first, "u1").count() == 2 and catalog.vacuum(0) == []


def test_failed_ingest_is_recorded(catalog, tmp_path):
    bad = catalog.register("u1", write(tmp_path / "bad.json", "[]"))
    with pytest.raises(ValueError):
        catalog.ingest(bad, "u1")
    record = catalog.detail(bad, "u1")
    assert record.status == "error" and "non-empty" in record.error_message


def test_owner_join_keeps_datasets_without_owner(spark):
    d = spark.createDataFrame([("u1",), ("u9",)], "owner_id string")
    u = spark.createDataFrame([("u1", "Asha")], "owner_id string, username string")
    assert sorted(rows_of(with_owner(d, u)), key=str) == [("u1", "Asha"), ("u9", None)]


def test_incremental_ingest(spark, tmp_path):
    source, target, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()

    def run(files):
        for name, lines in files.items():
            write(source / name, "\n".join(json.dumps(x) for x in lines))
        query = ingest_folder(
            spark, str(source), "`User Name` string, v int", target, mark, files_per_batch=1, trim=True
        )
        query.awaitTermination()
        return ingested(spark, target)

    df = run({"a.json": [{"User Name": " x ", "v": 1}, {"User Name": "y", "v": 2}], "b.json": [{"User Name": "z", "v": 3}]})
    assert sorted(r.row_index for r in df.collect()) == [0, 1, 2]
    assert {r.user_name for r in df.collect()} == {"x", "y", "z"}
    df = run({"c.json": [{"User Name": "w", "v": 4}]})
    assert {(r.row_index, r.v) for r in df.collect() if r.v == 4} == {(3, 4)}
    status = spark.read.parquet(f"{target}/status")
    assert status.agg(F.sum("n_rows")).first()[0] == 4


@pytest.mark.parametrize("per_batch", [1, 100])
def test_ingest_sets_bad_files_aside(spark, tmp_path, per_batch):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for k in range(6):
        write(source / f"f{k}.json", "".join(json.dumps({"v": 10 * k + i}) + "\n" for i in range(k + 1)))
    write(source / "f2.json", '{"v": 1}\n{"v": \n')
    write(source / "f4.json", '{"v": "no number"}\n')

    def run(mark):
        ingest_folder(spark, str(source), "v int", target, str(tmp_path / mark), files_per_batch=per_batch).awaitTermination()
        return sorted((r.row_index, r.v) for r in ingested(spark, target).collect())

    got = run("mark")
    assert [i for i, _ in got] == list(range(13))
    assert sorted(v for _, v in got) == sorted(10 * k + i for k in (0, 1, 3, 5) for i in range(k + 1))
    if per_batch > 1:
        assert [v for _, v in got] == [10 * k + i for k in (0, 1, 3, 5) for i in range(k + 1)]
    status = {r.file.rsplit("/", 1)[1]: r for r in ingest_status(spark, target).collect()}
    assert {f: (r.status, r.n_rows) for f, r in status.items()} == {
        "f0.json": ("ready", 1), "f1.json": ("ready", 2), "f2.json": ("error", 0), "f3.json": ("ready", 4), "f4.json": ("error", 0), "f5.json": ("ready", 6)
    }
    assert "MALFORMED" in status["f2.json"].error_message.upper() and status["f0.json"].error_message == ""
    if per_batch > 1:
        assert run("again") == got  # the same batch once more, as after a failure


def test_ingest_of_bad_files_only(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    write(source / "a.json", "{")
    ingest_folder(spark, str(source), "v int", target, str(tmp_path / "mark")).awaitTermination()
    assert [r.status for r in ingest_status(spark, target).collect()] == ["error"]
    write(source / "b.json", '{"v": 1}\n')
    ingest_folder(spark, str(source), "v int", target, str(tmp_path / "mark")).awaitTermination()
    assert [(r.row_index, r.v) for r in ingested(spark, target).collect()] == [(0, 1)]


def test_blocks_are_summed_up_as_line_by_line():
    """States of lines in blocks of any size, cut anywhere into batches, against one line at a time."""
    rng = random.Random(31)
    names = ["_file", "_block", "_line", "from_0", "from_1", "filled"]
    rows = [(f"f{i // 400}", i // 37, i, rng.choice([0, 0, 1]), rng.choice([0, 1, 1]), rng.random() < 0.3) for i in range(1200)]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int8(), pa.int8(), pa.bool_()]
    batches, at = [], 0
    while at < len(rows):
        part = rows[at : at + rng.randrange(90)]
        at += len(part)
        batches.append(pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], k) for i, k in enumerate(kinds)], names))
    want = {}
    for file, block, line, f0, f1, filled in rows:
        s = want.setdefault((file, block), [0, 1, False, False, True, None])
        s[0], s[1] = (f1 if s[0] else f0), (f1 if s[1] else f0)
        s[2], s[3], s[4] = s[2] or s[0] == 1, s[3] or s[1] == 1, s[4] and s[1] == 1
        if filled and s[5] is None:
            s[5] = line
    got = [tuple(c[0].as_py() for c in b.columns) for b in delimited._summed_up(iter(batches))]
    assert got == [(*key, *s) for key, s in want.items()]


def test_lines_that_cross_blocks_are_joined_once(spark, tmp_path, block_bytes, monkeypatch):
    written = []

    def kept(df):
        written.append(df.columns)
        return keep(df)

    keep = delimited.stored
    monkeypatch.setattr(delimited, "stored", kept)
    cells = [f"a{i}\n{'x' * (i % 23)}" for i in range(200)]
    (tmp_path / "t.csv").write_text("k,v\n" + "".join(f'{i},"{c}"\n' for i, c in enumerate(cells)))
    block_bytes(64)
    got = readers.read_csv(spark, str(tmp_path / "t.csv")).collect()
    assert sorted((r.k, r.v) for r in got) == list(enumerate(cells))
    assert sum("part" in columns for columns in written) == 1
