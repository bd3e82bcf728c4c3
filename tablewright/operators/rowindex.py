"""Dense row numbers and running totals without a one-task window.

Rows are range-partitioned by the whole order key and sorted inside each partition; every row then
knows its partition and its place in it. One small aggregate gives the size of each partition, and
a row's global place is the size of the partitions before it plus its own place. The order key
should end in unique columns: then even a value that a third of the rows share is cut across
partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.parsing import column
from tablewright.session import broadcast_if_small, stored

INDEX = "row_index"
_PLACE_BITS = 33  # monotonically_increasing_id keeps the place in the partition in its low 33 bits


def _placed(df: DataFrame, order_by: list | None) -> DataFrame:
    """Ordered rows with ``_slice`` (partition) and ``_place`` (0-based place in it), written once."""
    if order_by:
        keys = [key if isinstance(key, Column) else column(key) for key in order_by]
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    written = stored(df.withColumn("_id", F.monotonically_increasing_id()))
    return written.select(
        *_cells(df),
        F.shiftright("_id", _PLACE_BITS).alias("_slice"),
        F.col("_id").bitwiseAND((1 << _PLACE_BITS) - 1).alias("_place"),
    )


def _cells(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]


def _before(sizes: DataFrame, size: str) -> DataFrame:
    """Totals of all earlier slices; there is one row per partition, so one task suffices."""
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_slice", F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias("_before"))


def dense_index(df: DataFrame, order_by: list | None = None, name: str = INDEX) -> DataFrame:
    """Rows numbered 0..n-1 in the order of ``order_by``, or as they are read if there is none."""
    placed = _placed(df, order_by)
    sizes = placed.groupBy("_slice").agg(F.count("*").alias("_size"))
    # One row per partition, hence broadcastable however large the table is.
    offsets = F.broadcast(_before(sizes, "_size"))
    return placed.join(offsets, "_slice").select(
        (F.col("_before") + F.col("_place")).alias(name), *_cells(df)
    )


def file_index(df: DataFrame, name: str = INDEX) -> DataFrame:
    """Rows numbered in file order, for an unfiltered table read from Parquet files.

    Uses the row position that the scan itself knows, so the data is not shuffled: only one row per
    file is aggregated, and those rows are broadcast while they are few enough.
    """
    tagged = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = tagged.groupBy("_file").agg((F.max("_row") + 1).alias("_size"))
    ended = running_total(sizes, ["_file"], "_size", "_end")
    offsets = ended.select("_file", (F.col("_end") - F.col("_size")).alias("_before"))
    return tagged.join(broadcast_if_small(offsets), "_file").select((F.col("_before") + F.col("_row")).alias(name), *_cells(df))


def running_total(df: DataFrame, order_by: list, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to and including this one, in ``order_by`` order."""
    placed = _placed(df, order_by)
    sizes = placed.groupBy("_slice").agg(F.sum(value).alias("_size"))
    offsets = F.broadcast(_before(sizes, "_size"))
    within = Window.partitionBy("_slice").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("_part", F.sum(value).over(within))
        .join(offsets, "_slice")
        .select(*_cells(df), (F.col("_before") + F.col("_part")).alias(name))
    )


def row_count(df: DataFrame, index: str = INDEX) -> Column:
    """Number of rows of a densely indexed table, as a scalar subquery."""
    return df.agg(F.coalesce(F.max(index) + 1, F.lit(0))).scalar()
