"""Reading tables: by file type, JSON in several layouts, delimited text, and stored row documents."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.names import clean_names
from tablewright.functions.parsing import column, is_text_type, numeric, quoted
from tablewright.operators.rowindex import INDEX
from tablewright.sources.delimited import delimited_table
from tablewright.sources.order import BLOCK, FILE, LATE, ORDER, PLACE, block_columns, placed, without_order

# File endings and how they are read.
FORMATS = {
    ".json": "json",
    ".jsonl": "jsonl",
    ".ndjson": "jsonl",
    ".csv": "csv",
    ".parquet": "parquet",
    ".orc": "orc",
}
ORIENTS = ["records", "split", "index", "columns", "values"]

#: How JSON is parsed: what is malformed raises.
STRICT = {"mode": "FAILFAST"}
BLANKS = " \t\r\n\ufeff"


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """A table with clean column names; the file ending picks the reader unless ``fmt`` is given."""
    return without_order(read_source(spark, path, fmt, **options)[0])


def read_source(spark: SparkSession, path: str, fmt: str | None = None, **options) -> tuple[DataFrame, bool]:
    """The same with the places of its rows, and whether the rows still stand in them (see ``order.source_index``)."""
    fmt = fmt or FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower())
    if fmt is None:
        raise ValueError(f"unsupported file type of {path!r}; use one of {', '.join(FORMATS)}")
    try:
        if fmt == "csv":
            return delimited_table(spark, path, **{"typed": True, **options}), True
        if fmt == "json":
            df, names, in_place = _json(spark, path, **options)
        elif fmt == "jsonl":
            df, names, in_place = _json_lines(spark, path, **options)
        else:
            scan = spark.read.options(**options).format(fmt).load(path)
            df, names, in_place = _numbered(placed(scan), scan.columns), scan.columns, True
    except ValueError:
        raise
    except Exception as error:
        raise ValueError(f"failed to read {path!r}: {error}") from error
    return df.toDF(*clean_names(names), *ORDER), in_place


def _numbered(df: DataFrame, names: list[str]) -> DataFrame:
    """Own columns under neutral names, which those of the places never clash with."""
    return df.toDF(*[f"c{i}" for i in range(len(names))], *ORDER)


def read_csv(spark: SparkSession, path: str, sep: str = ",", typed: bool = True) -> DataFrame:
    """Delimited text with a header line in each file; names come from the raw header, so repeats are numbered.

    Cells may hold separators and line breaks, also where files are read in parallel blocks; rows longer than the
    header give further columns. All cells are read as text; columns that are entirely numeric become DOUBLE, decided by one
    aggregate over the file rather than by the reader's own inference.
    """
    return without_order(delimited_table(spark, path, sep, typed))


def parse_lines(df: DataFrame, line: Column, names: list[str], sep: str = ",") -> DataFrame:
    """Delimited lines held in a column, as text columns."""
    schema = ", ".join(f"{quoted(n)} string" for n in names)
    return df.select(F.from_csv(line, schema, {"sep": sep, "escape": '"'}).alias("_r")).select("_r.*")


def whole_numeric(df: DataFrame) -> dict[str, bool]:
    """Per text column: whether every non-null cell is a number (one aggregate)."""
    names = [f.name for f in df.schema.fields if is_text_type(f.dataType)]
    if not names:
        return {}
    aggs = []
    for i, n in enumerate(names):
        aggs += [F.count(column(n)).alias(f"n{i}"), F.count(numeric(column(n))).alias(f"m{i}")]
    found = df.agg(*aggs).first()
    return {n: found[f"n{i}"] == found[f"m{i}"] for i, n in enumerate(names)}


def numeric_where_whole(df: DataFrame) -> DataFrame:
    """Text columns whose every cell is a number become DOUBLE; one bad cell keeps a column as text."""
    whole = whole_numeric(df)
    return df.select(
        *[(numeric(column(c)) if whole.get(c) else column(c)).alias(c) for c in df.columns]
    )


# -- JSON -----------------------------------------------------------------------------------------


def read_json(spark: SparkSession, path: str, orient: str | None = None, typed: bool = True) -> DataFrame:
    """JSON files that are one document each: an array of objects, or an object in one of five layouts.

    Columns come in the order in which their names first occur, by file, row and place in the row. Objects of an array have the types that the reader
    finds; in the other layouts a column becomes BIGINT, DOUBLE or BOOLEAN if all its cells are such, unless ``typed`` is false.
    A document that is cut off or otherwise malformed is an error. One document is one task in any engine; for large data write JSON lines and read ``jsonl``.
    """
    df, names, _ = _json(spark, path, orient, typed)
    return without_order(df).toDF(*names)


def _json(spark: SparkSession, path: str, orient: str | None = None, typed: bool = True) -> tuple[DataFrame, list[str], bool]:
    scan = spark.read.text(path, wholetext=True)
    documents = scan.select(F.trim("value", F.lit(BLANKS)).alias("value"), F.col("_metadata.file_path").alias(FILE)).where("value <> ''")
    kinds = documents.select(F.concat(F.left("value", F.lit(1)), F.right("value", F.lit(1))).alias("kind"), F.element_at(F.split(FILE, "/"), -1).alias("file"))
    seen = kinds.agg(F.max_by("file", ~F.col("kind").isin("[]", "{}")).alias("file"), F.min("kind").alias("low"), F.max("kind").alias("high")).first()
    if seen["low"] is None:
        raise ValueError("the file is empty")
    if not {seen["low"], seen["high"]} <= {"[]", "{}"}:
        raise ValueError(f"{seen['file']} must be an array of objects or an object, from its first to its last character")
    if seen["low"] != seen["high"] and orient is None:
        raise ValueError("some files are arrays and some are objects; name their orient")
    if seen["low"] == "[]" and orient in (None, "records"):
        rows = documents.select(FILE, F.posexplode(F.from_json("value", "array<map<string,string>>", STRICT)).alias(PLACE, "_r"))
        names = _names(rows.select(F.struct(FILE, PLACE).alias("_o"), "_r"))
        table = spark.read.options(multiLine=True, **STRICT).json(path)
        return _numbered(placed(table.select(*[column(n) for n in names], F.col("_metadata"))).drop("_metadata"), names), names, True
    rows = _rows(documents.select(F.col(FILE).alias("_doc"), F.col("value").alias("_text")), orient or _orient_of(documents))
    df, names = _wide(rows, [F.col("_doc").alias(FILE), F.lit(0).cast("long").alias(BLOCK), F.col("_at").cast("long").alias(PLACE), F.lit(False).alias(LATE)])
    df = _numbered(df, names)
    return (_typed(df, [c for c in df.columns if c not in ORDER]) if typed else df), names, False


def _json_lines(spark: SparkSession, path: str, **options) -> tuple[DataFrame, list[str], bool]:
    """JSON lines, read in parallel blocks; a malformed line is an error unless ``mode`` says otherwise."""
    table = spark.read.options(**{**STRICT, **options}).json(path)
    lines = spark.read.text(path).where("trim(value) <> ''")
    order = F.struct(*block_columns(), F.monotonically_increasing_id())
    found = _names(lines.select(order.alias("_o"), F.from_json("value", "map<string,string>").alias("_r")))
    names = [n for n in found if n in table.columns] + [n for n in table.columns if n not in found]
    return _numbered(placed(table.select(*[column(n) for n in names], F.col("_metadata"))).drop("_metadata"), names), names, True


def _typed(df: DataFrame, among: list[str]) -> DataFrame:
    """Text columns whose every non-null cell is a whole number, a number or a truth value, as such (one aggregate)."""
    kinds = {"bigint": lambda c: c.rlike(r"^-?\d{1,18}$"), "double": lambda c: numeric(c).isNotNull(), "boolean": lambda c: c.isin("true", "false")}
    aggs = [F.count_if(column(n).isNotNull() & ~fits(column(n))).alias(f"{n}_{kind}") for n in among for kind, fits in kinds.items()]
    misses = df.agg(*aggs, *[F.count(column(n)).alias(f"{n}_n") for n in among]).first()

    def cell(name: str) -> Column:
        kind = next((k for k in kinds if misses[f"{name}_n"] and not misses[f"{name}_{k}"]), None)
        if kind is None:
            return column(name)
        return (numeric(column(name)) if kind == "double" else column(name).cast(kind)).alias(name)

    return df.select(*[cell(c) if c in among else column(c) for c in df.columns])


def _orient_of(documents: DataFrame) -> str:
    """The layout of an object, from the kinds of its members.

    An object of objects and an object of equally long arrays list columns; ``columns``/``index``/
    ``data`` arrays of different lengths are the split layout; plain values are one row.
    """
    member = F.from_json("value", "map<string,string>")
    kinds = documents.select(F.explode(member).alias("key", "member")).select(
        "key", F.substring("member", 1, 1).alias("kind"), F.json_array_length("member").alias("size")
    )
    seen = kinds.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("kind") == "{").alias("objects"),
        F.count_if(F.col("kind") == "[").alias("lists"),
        F.countDistinct("size").alias("sizes"),
        F.count_if(F.col("key").isin("columns", "data")).alias("split_keys"),
    ).first()
    if seen["split_keys"] >= 2 and seen["lists"] >= 2 and seen["sizes"] > 1:
        return "split"
    if seen["n"] and seen["objects"] == seen["n"]:
        return "columns"
    if seen["n"] and seen["lists"] == seen["n"]:
        return "lists"
    raise ValueError("cannot read this JSON structure; name its orient")


def from_documents(df: DataFrame, text: str, orient: str) -> DataFrame:
    """Rows of many JSON documents of one layout; cells are text, nested cells stay JSON text.

    Column names are the union over all documents, in the order in which they first occur. Documents are exploded, so many of
    them spread over the cluster. Layouts that hold whole rows need no shuffle; layouts that hold whole columns
    are regrouped by document and row. A malformed document is an error.
    """
    docs = df.select(F.monotonically_increasing_id().alias("_doc"), F.col(text).alias("_text"))
    wide, names = _wide(_rows(docs, orient), [])
    return wide.toDF(*names)


def _rows(docs: DataFrame, orient: str) -> DataFrame:
    """``(_doc, _at, _r)`` of documents ``(_doc, _text)``: each row as a map from names to cells, and its place in its document."""
    cells, names = "map<string,string>", "array<string>"

    def parsed(text, kind: str) -> Column:
        return F.from_json(text, kind, STRICT)

    if orient == "records":
        return docs.select("_doc", F.posexplode(parsed("_text", names)).alias("_at", "_r")).select("_doc", "_at", parsed("_r", cells).alias("_r"))
    if orient == "index":
        rows = docs.select("_doc", F.posexplode(F.map_entries(parsed("_text", cells))).alias("_at", "_e"))
        return rows.select("_doc", "_at", parsed("_e.value", cells).alias("_r"))
    if orient == "values":
        rows = docs.select("_doc", F.posexplode(parsed("_text", names)).alias("_at", "_r")).select("_doc", "_at", parsed("_r", names).alias("_r"))
        labels = F.transform(F.sequence(F.lit(0), F.size("_r") - 1), lambda i: i.cast("string"))
        return rows.where(F.size("_r") > 0).select("_doc", "_at", F.map_from_arrays(labels, "_r").alias("_r"))
    if orient == "split":
        parts = parsed("_text", "struct<columns:array<string>,data:array<string>>")
        rows = docs.select("_doc", parts.alias("_p")).select("_doc", F.col("_p.columns").alias("_names"), F.posexplode("_p.data").alias("_at", "_r"))
        return rows.select("_doc", "_at", F.map_from_arrays("_names", parsed("_r", names)).alias("_r"))
    if orient not in ("columns", "lists"):
        raise ValueError(f"orient must be one of {', '.join(ORIENTS)}")
    outer = docs.select("_doc", F.posexplode(F.map_entries(parsed("_text", cells))).alias("_col", "_e")).select("_doc", "_col", "_e.key", "_e.value")
    if orient == "columns":
        inner = outer.select("_doc", "_col", "key", F.posexplode(F.map_entries(parsed("value", cells))).alias("_place", "_e"))
        spread = inner.select("_doc", "_col", "key", "_place", F.col("_e.key").alias("_row"), F.col("_e.value").alias("_cell"))
    else:
        spread = outer.select("_doc", "_col", "key", F.posexplode(parsed("value", names)).alias("_place", "_cell")).withColumn("_row", F.col("_place"))
    # One entry per column of the row, in the order of the columns; a row stands where the first column that has it puts it.
    entries = F.array_sort(F.collect_list(F.struct("_col", "key", "_cell")))
    rows = spread.groupBy("_doc", "_row").agg(entries.alias("_e"), F.min(F.struct("_col", "_place")).alias("_first"))
    at = F.shiftleft(F.col("_first._col").cast("long"), 40) + F.col("_first._place")
    return rows.select("_doc", at.alias("_at"), F.map_from_entries(F.transform("_e", lambda e: F.struct(e["key"], e["_cell"]))).alias("_r"))


def _names(rows: DataFrame) -> list[str]:
    """Names in rows ``(_o, _r)``, ordered by the first row (by ``_o``) that has them and their place there; the driver gets one row for each."""
    keys = rows.select("_o", F.posexplode(F.map_keys("_r")).alias("_p", "_k"))
    names = [r["_k"] for r in keys.groupBy("_k").agg(F.min(F.struct("_o", "_p")).alias("_first")).orderBy("_first").collect()]
    if not names:
        raise ValueError("the JSON must be a non-empty table")
    return names


def _wide(rows: DataFrame, places: list[Column]) -> tuple[DataFrame, list[str]]:
    """Maps ``_r`` as columns ``c0..``, followed by ``places``, and the names of the columns."""
    names = _names(rows.select(F.struct("_doc", "_at").alias("_o"), "_r"))
    return rows.select(*[F.col("_r")[F.lit(n)].alias(f"c{i}") for i, n in enumerate(names)], *places), names


# -- stored rows ----------------------------------------------------------------------------------


def rows_to_table(rows: DataFrame, columns: list[str] | T.StructType, data: str = "data", index: str = INDEX) -> DataFrame:
    """Row documents ``(row_index, data JSON)`` as a table over the declared columns.

    Missing keys are NULL, undeclared keys are dropped, nested values stay JSON text unless the
    columns are given with types.
    """
    schema = columns
    if not isinstance(columns, T.StructType):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return rows.select(index, F.from_json(data, schema).alias("_r")).select(index, "_r.*")
