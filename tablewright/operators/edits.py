"""Cell and row edits on a densely indexed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.parsing import column, quoted
from tablewright.operators.deletions import deletion_vector, without_removed
from tablewright.operators.rowindex import INDEX, row_count

# Up to this many removed rows are subtracted inside an expression, which gives the same result as the vector of removals.
INLINE_DELETES = 64


def _checked(df: DataFrame, edits: DataFrame, index: str) -> DataFrame:
    """Edits with ``_no`` (their order) and ``_fault``, why an edit cannot be made, but for unknown rows."""
    types = {c: t for c, t in df.dtypes if c != index}
    name, value = F.col("column"), F.col("value")
    fits = F.lit(False)
    for kind in sorted({t for t in types.values() if "<" not in t}):  # a text is no value of a nested column
        fits = fits | (name.isin([c for c, t in types.items() if t == kind]) & value.try_cast(kind).isNotNull())
    fault = F.when(F.col("row_index").isNull(), "no row").when(name.isNull() | ~name.isin(list(types)), "unknown column").when(value.isNotNull() & ~fits, "bad value")
    return edits.withColumns({"_no": F.col("edit_no") if "edit_no" in edits.columns else F.lit(0), "_fault": fault})


def update_cells(df: DataFrame, edits: DataFrame, index: str = INDEX) -> DataFrame:
    """Applies ``edits`` ``(row_index, column, value string[, edit_no])``; the last edit of a cell wins.

    Edits become one row per edited table row, so the table is joined once on its unique index.
    Values are cast to the column's type; a NULL value clears the cell. An edit that cannot be made changes nothing
    and is listed by :func:`rejected_edits`.
    """
    known = [c for c in df.columns if c != index]
    final = (
        _checked(df, edits, index)
        .where("_fault is null")
        .groupBy("row_index", "column")
        .agg(F.max_by(F.struct("value"), F.struct("_no", "value")).alias("edit"))
        .groupBy(F.col("row_index").alias(index))
        # At most one entry per column of the table.
        .agg(F.map_from_entries(F.collect_list(F.struct("column", "edit"))).alias("_edits"))
    )
    types = dict(df.dtypes)

    def cell(name: str):
        edit = F.col("_edits")[F.lit(name)]
        new = F.lit(None) if "<" in types[name] else edit["value"].try_cast(types[name])
        return F.when(edit.isNotNull(), new).otherwise(column(name)).alias(name)

    return df.join(final, index, "left").select(index, *[cell(name) for name in known])


def rejected_edits(df: DataFrame, edits: DataFrame, index: str = INDEX) -> DataFrame:
    """Edits that :func:`update_cells` cannot make, with ``reason``: no row, unknown row, unknown column or bad value.

    Only the index of the table is read.
    """
    checked = _checked(df, edits, index)
    rows = df.select(column(index).alias("_known")).distinct()
    joined = checked.join(rows, F.col("row_index") == F.col("_known"), "left")
    reason = F.coalesce("_fault", F.when(F.col("_known").isNull(), F.lit("unknown row")))
    return joined.select(*[column(c) for c in edits.columns], reason.alias("reason")).where("reason is not null")


def update_cell(df: DataFrame, row: int, name: str, value, index: str = INDEX) -> DataFrame:
    """One cell; an expression, no join."""
    if name not in df.columns:
        raise ValueError(f"column {name!r} not found")
    if df.where(F.col(index) == row).isEmpty():
        raise ValueError(f"row {row} not found")
    new = F.lit(value).cast(df.schema[name].dataType)
    return df.withColumn(name, F.when(F.col(index) == row, new).otherwise(column(name)))


def append_rows(df: DataFrame, rows: list[dict], index: str = INDEX) -> DataFrame:
    """Adds rows after the last one; unknown keys are dropped, missing cells are blank text or NULL."""
    data = [c for c in df.columns if c != index]
    types = dict(df.dtypes)
    blank = {c: "" if types[c] == "string" else None for c in data}
    given = [
        (i, *[None if (v := {**blank, **row}[c]) is None else str(v) for c in data]) for i, row in enumerate(rows)
    ]
    schema = "_offset bigint, " + ", ".join(f"{quoted(c)} string" for c in data)
    new = df.sparkSession.createDataFrame(given, schema)
    for c in data:  # the rows are given by the driver, so they can be looked at here
        wrong = new.where(column(c).isNotNull() & column(c).try_cast(types[c]).isNull()).select(c).first()
        if wrong is not None:
            raise ValueError(f"{wrong[0]!r} is no value of column {c!r} ({types[c]})")
    start = row_count(df, index)
    typed = new.select((start + F.col("_offset")).alias(index), *[column(c).try_cast(types[c]).alias(c) for c in data])
    return df.select(index, *data).unionByName(typed)


def delete_rows(df: DataFrame, rows: list[int] | DataFrame, index: str = INDEX) -> DataFrame:
    """Removes rows, given as a list or as a table with a column ``index``, without sorting or numbering the table anew.

    Each remaining index drops by the number of removed indices below it, so a dense index stays dense and gaps stay gaps, however many
    rows are removed. Indices that no row has count as removed, too.
    """
    if not isinstance(rows, DataFrame):
        gone = sorted(set(rows))
        if len(gone) <= INLINE_DELETES:
            below = F.lit(0)
            for r in gone:
                below = below + (F.col(index) > r).cast("int")
            return df.where(~F.col(index).isin(gone)).withColumn(index, F.col(index) - below)
        rows = df.sparkSession.createDataFrame([(r,) for r in sorted(set(rows))], f"{quoted(index)} bigint")
    return without_removed(df, deletion_vector(rows, index), index).select(*[column(c) for c in df.columns])
