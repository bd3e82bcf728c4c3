"""The order of rows in their files, and dense numbers in that order.

A scan deals files out to tasks by size, so the order of partitions is not that of the files. A row is placed by its
file, by the block of the file in which it begins, and by its place there; blocks are counted, and a row's
number is what all earlier blocks hold plus its place in its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.parsing import column
from tablewright.operators.rowindex import INDEX, dense_index, running_total
from tablewright.session import broadcast_if_small, stored

FILE, BLOCK, PLACE, LATE = "_file", "_block", "_line", "_late"
ORDER = [FILE, BLOCK, PLACE, LATE]


def block_columns() -> list[Column]:
    """File and block of the rows of a scan."""
    return [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK)]


def placed(scan: DataFrame) -> DataFrame:
    """A scan of files, whatever their format, with the places of its rows."""
    return scan.select(*[column(c) for c in scan.columns], *block_columns(), F.monotonically_increasing_id().alias(PLACE), F.lit(False).alias(LATE))


def without_order(df: DataFrame) -> DataFrame:
    return df.drop(*ORDER)


def source_index(df: DataFrame, in_place: bool = True, name: str = INDEX) -> DataFrame:
    """Rows with places numbered 0..n-1 in the order of their files (by path), blocks and places.

    ``in_place``: the rows of a block still stand one after the other as the scan gave them, but for at most one *late* row
    that follows them. Then the table is not shuffled: it is written once, and only one row per block is
    summed and joined. Rows that have been dealt out anew are sorted by their places.
    """
    own = [c for c in df.columns if c not in ORDER]
    if not in_place:
        return dense_index(df, [FILE, BLOCK, PLACE], name).select(name, *[column(c) for c in own])
    written = stored(df.withColumn("_id", F.monotonically_increasing_id()))
    early = F.when(~F.col(LATE), F.col("_id"))
    sizes = written.groupBy(FILE, BLOCK).agg(F.min(early).alias("_first"), F.count(early).alias("_early"), F.count("*").alias("_size"))
    ended = running_total(sizes, [FILE, BLOCK], "_size", "_end")
    offsets = stored(ended.select(FILE, BLOCK, "_first", "_early", (F.col("_end") - F.col("_size")).alias("_before")))
    within = F.when(F.col(LATE), F.col("_early")).otherwise(F.col("_id") - F.col("_first"))
    return written.join(broadcast_if_small(offsets), [FILE, BLOCK]).select((F.col("_before") + within).alias(name), *[column(c) for c in own])
