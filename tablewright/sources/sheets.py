"""Messy sheets: from raw cell grids to one clean table.

A grid is a DataFrame ``(sheet string, row_idx bigint, cells array<string>)`` without a header, as a
text or CSV reader gives it. Decisions (header row, kept columns, numeric columns) come from small
aggregates per sheet; the cells are then read once, for all sheets together.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.names import clean_names
from tablewright.functions.parsing import FLOAT_LITERAL, column, is_text_type, numeric
from tablewright.sources.delimited import cells

# The limits of header detection and sheet validity.
HEADER_SCAN_ROWS = 10
MIN_HEADER_FILL = 0.35
MAX_LABEL = 80
MIN_RAW_ROWS = 2
NEAR_ROWS = 1000  # where a header is looked for first
MIN_COLUMNS = 2
SHEET_TAG = "_sheet"


def is_label(cell: Column) -> Column:
    """Non-blank text of at most 80 characters that is not a number."""
    text = F.regexp_replace(cell, r"^\s+|\s+$", "")
    return F.coalesce(
        (F.length(text) > 0) & (F.length(text) <= MAX_LABEL) & ~cell.rlike(FLOAT_LITERAL), F.lit(False)
    )


def drop_blank_rows(df: DataFrame, index: str | None = None) -> DataFrame:
    """Without rows whose cells are all NULL."""
    cells = [c for c in df.columns if c != index]
    return df.na.drop("all", subset=cells)


def drop_blank_columns(df: DataFrame) -> DataFrame:
    """Without columns whose cells are all NULL; one aggregate counts every column."""
    counts = df.agg(*[F.count(column(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[column(c) for i, c in enumerate(df.columns) if counts[f"n{i}"] > 0])


def _filled(grid: DataFrame) -> DataFrame:
    return grid.where(F.exists("cells", lambda c: c.isNotNull()))


def column_counts(grid: DataFrame) -> DataFrame:
    """``(sheet, raw_rows, used, filled, filled_near)`` per sheet, in one aggregate.

    ``used`` counts the non-null cells per position; ``filled`` the rows that hold anything, and
    ``filled_near`` those among the first rows of the sheet.
    """
    used = F.array(*[F.count(F.get("cells", F.lit(i))) for i in range(_width(grid))]).cast("array<bigint>")
    is_filled = F.exists("cells", lambda c: c.isNotNull())
    return grid.groupBy("sheet").agg(
        F.count("*").alias("raw_rows"),
        used.alias("used"),
        F.count_if(is_filled).alias("filled"),
        F.count_if(is_filled & (F.col("row_idx") < NEAR_ROWS)).alias("filled_near"),
    )


def _width(grid: DataFrame) -> int:
    return grid.agg(F.max(F.size("cells"))).first()[0] or 0


def header_rows(grid: DataFrame) -> DataFrame:
    """``(sheet, header_idx)``: the first of the first 10 filled rows with enough labels, else the first.

    Labels are counted against the columns that hold anything. If every sheet shows 10 filled rows
    (or all it has) near its start, only that part is ranked. Otherwise all rows are, and Spark
    applies the rank limit before the shuffle, so a huge sheet is not moved to one task.
    """
    # One row per sheet.
    counts = [r for r in column_counts(grid).collect() if r["raw_rows"] >= MIN_RAW_ROWS]
    all_near = all(r["filled_near"] >= min(HEADER_SCAN_ROWS, r["filled"]) for r in counts)
    widths = grid.sparkSession.createDataFrame(
        [(r["sheet"], sum(n > 0 for n in r["used"])) for r in counts], "sheet string, n_cols int"
    )
    near = grid.where(F.col("row_idx") < NEAR_ROWS) if all_near else grid
    place = F.row_number().over(Window.partitionBy("sheet").orderBy("row_idx"))
    first_rows = _filled(near).withColumn("_place", place).where(F.col("_place") <= HEADER_SCAN_ROWS)
    labels = F.size(F.filter("cells", is_label))
    return (
        first_rows.join(F.broadcast(widths), "sheet")
        .groupBy("sheet")
        .agg(
            F.min(F.when(labels / F.col("n_cols") >= MIN_HEADER_FILL, F.col("row_idx"))).alias("_found"),
            F.min("row_idx").alias("_first"),
        )
        .select("sheet", F.coalesce("_found", "_first").alias("header_idx"))
    )


@dataclass
class SheetLayout:
    """Where a sheet's header is, and the cell position of each header text that has values."""

    sheet: str
    header_idx: int
    positions: dict[str, int] = field(default_factory=dict)
    numeric: set[str] = field(default_factory=set)


def sheet_layouts(grid: DataFrame) -> list[SheetLayout]:
    """The usable sheets in name order: at least two used columns and one data row under the header.

    Collects one row per sheet, not cells; the grid is read once for all body counts.
    """
    found = header_rows(grid).collect()
    headers = F.broadcast(grid.sparkSession.createDataFrame(found, "sheet string, header_idx bigint"))
    rows = grid.join(headers, "sheet").where(F.col("row_idx") >= F.col("header_idx"))
    is_body = F.col("row_idx") > F.col("header_idx")
    cells = [F.when(is_body, F.get("cells", F.lit(i))) for i in range(_width(grid))]
    bodies = rows.groupBy("sheet").agg(
        F.first("header_idx").alias("header_idx"),
        F.first(F.when(~is_body, F.col("cells")), ignorenulls=True).alias("cells"),
        F.array(*[F.count(c) for c in cells]).alias("used"),
        F.array(*[F.count(numeric(c)) for c in cells]).alias("nums"),
    )
    layouts = []
    for row in bodies.orderBy("sheet").collect():
        kept = [i for i, n in enumerate(row["used"]) if n > 0]
        if len(kept) < MIN_COLUMNS:
            continue
        headers_of = _header_texts(row["cells"], len(row["used"]))
        layout = SheetLayout(row["sheet"], row["header_idx"])
        for i in kept:
            name = headers_of[i]
            layout.positions[name] = i
            if row["nums"][i] == row["used"][i]:
                layout.numeric.add(name)
        layouts.append(layout)
    return layouts


def _header_texts(cells: list, width: int) -> list[str]:
    """One distinct text per position: blanks are named by position, repeats are numbered."""
    texts: list[str] = []
    for i in range(width):
        text = cells[i] if i < len(cells) and cells[i] is not None else f"Unnamed: {i}"
        repeats = 0
        while (name := f"{text}.{repeats}" if repeats else text) in texts:
            repeats += 1
        texts.append(name)
    return texts


def normalise(grid: DataFrame) -> DataFrame:
    """All usable sheets as one table.

    Columns appear in first-seen order and are matched by header text; then all names are cleaned.
    With more than one usable sheet a ``sheet`` column comes first. A column is DOUBLE if all its
    cells, in all sheets that have it, are numbers. ``row_idx`` keeps the position in the sheet.
    """
    layouts = sheet_layouts(grid)
    if not layouts:
        raise ValueError("no usable data sheets found")
    headers = list(dict.fromkeys(n for lay in layouts for n in lay.positions))
    tags = [SHEET_TAG] if len(layouts) > 1 else []
    clean = clean_names(tags + headers)
    plan = grid.sparkSession.createDataFrame(
        [(lay.sheet, lay.header_idx, [lay.positions.get(n) for n in headers]) for lay in layouts],
        "sheet string, header_idx bigint, _at array<int>",
    )
    # The plan came through the driver, one row per sheet, so it is small.
    body = _filled(grid.join(F.broadcast(plan), "sheet").where(F.col("row_idx") > F.col("header_idx")))
    picked = []
    for j, (header, name) in enumerate(zip(headers, clean[len(tags) :])):
        cell = F.get("cells", F.col("_at")[j])
        whole = all(header in lay.numeric for lay in layouts if header in lay.positions)
        picked.append((numeric(cell) if whole else cell).alias(name))
    tag = [F.col("sheet").alias(name) for name in clean[: len(tags)]]
    return body.select(*tag, "row_idx", *picked)


def tagged_union(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables matched by column name under a ``_sheet`` tag; a single one is returned untagged.

    A column that is a number in one table and text in another becomes text.
    """
    if len(tables) == 1:
        return next(iter(tables.values()))
    text = {f.name for df in tables.values() for f in df.schema.fields if is_text_type(f.dataType)}
    parts = [
        df.select(F.lit(tag).alias(SHEET_TAG), *[column(c).cast("string").alias(c) if c in text else column(c) for c in df.columns])
        for tag, df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def text_grid(df: DataFrame, sheet: Column, row_idx: Column, line: Column, sep: str = ",") -> DataFrame:
    """A grid from delimited lines; ``sep`` stands for itself, quoted cells may hold it, and empty cells are NULL."""
    return df.select(sheet.alias("sheet"), row_idx.cast("long").alias("row_idx"), cells(line, sep).alias("cells"))
