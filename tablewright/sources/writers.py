"""Writing tables: row documents, delimited text and indexed loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.formatting import cell_text
from tablewright.functions.parsing import column
from tablewright.operators.rowindex import INDEX, dense_index

# Decimals kept in documents and the form of their timestamps.
DOCUMENT_DECIMALS = 10
DOCUMENT_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSS"


def _document_cell(df: DataFrame, name: str) -> Column:
    dtype, c = df.schema[name].dataType, column(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.round(c, DOCUMENT_DECIMALS))
    if isinstance(dtype, T.DateType):
        return c.cast("timestamp_ntz")
    return c


def row_documents(df: DataFrame, index: str = INDEX) -> DataFrame:
    """``(row_index, data)``: each row as a JSON object that keeps its null cells."""
    if len(set(df.columns)) != len(df.columns):
        raise ValueError("column names must be unique")
    cells = [_document_cell(df, c).alias(c) for c in df.columns if c != index]
    form = {"ignoreNullFields": "false", "timestampFormat": DOCUMENT_TIME, "timestampNTZFormat": DOCUMENT_TIME}
    return df.select(index, F.to_json(F.struct(*cells), form).alias("data"))


def delimited_lines(df: DataFrame, columns: list[str]) -> Column:
    """One row as delimited text: every value quoted, quotes doubled, missing values empty."""
    cells = [
        F.concat(
            F.lit('"'), F.replace(F.coalesce(cell_text(df, c), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')
        )
        for c in columns
    ]
    return F.concat_ws(",", *cells)


def header_line(columns: list[str]) -> str:
    return ",".join(columns)


def write_delimited(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """The whole table as quoted delimited files with a header each, columns in the given order."""
    columns = columns or df.columns
    cells = [F.coalesce(cell_text(df, c), F.lit("")).alias(c) for c in columns]
    writer = df.select(*cells).write.mode("overwrite").option("header", True).option("quoteAll", True)
    # Without these the writer would strip blanks and line breaks at the ends of cells.
    writer.options(escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def load_indexed(df: DataFrame, path: str, order_by: list[str] | None = None, index: str = INDEX) -> DataFrame:
    """Writes the table with a dense row index and returns it as read back.

    Rows are written in contiguous index ranges, so file statistics let a page or range filter skip
    most of the files.
    """
    dense_index(df, order_by, index).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
