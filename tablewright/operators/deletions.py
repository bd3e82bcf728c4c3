"""Removed rows of an indexed table as a vector of prefix counts, which every row is ranked by in one equi-join.

Indices are cut into blocks of a fixed width. A block with removals holds their places in order, how many of them precede each
of its sections, and how many rows were removed before the block. The new index of a row is its old one less what
was removed below: the block's count, the section's count, and the few removals of its own section that are smaller. However
many rows are removed, and whatever gaps the index has, the method is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.parsing import column
from tablewright.operators.rowindex import INDEX, running_total
from tablewright.session import stored

WIDTH, SECTION = 1 << 16, 1 << 8
#: A vector of up to so many removals and blocks is broadcast: 4 bytes each, and some 1,100 bytes for a block with removals.
BROADCAST_REMOVALS, BROADCAST_BLOCKS = 2_000_000, 20_000


def deletion_vector(removed: DataFrame, index: str = INDEX) -> DataFrame:
    """``(_dv_block, _dv_before, _dv_starts, _dv_places)`` for every block up to the last removal; repeated and null indices count once and not at all.

    Written once: its last block tells how far it reaches, and it is small beside the table.
    """
    ids = removed.select(column(index).cast("long").alias("_i")).where("_i >= 0").distinct()
    place = (F.col("_i") % WIDTH).cast("int")
    parts = ids.groupBy(F.floor(F.col("_i") / WIDTH).cast("long").alias("_dv_block"), F.floor(place / SECTION).cast("int").alias("section")).agg(
        F.array_sort(F.collect_list(place)).alias("held")  # at most SECTION
    )
    places = parts.groupBy("_dv_block").agg(F.array_sort(F.collect_list(F.struct("section", "held"))).alias("parts"))
    before = F.transform(
        F.sequence(F.lit(0), F.lit(WIDTH // SECTION)),
        lambda s: F.aggregate(F.filter("parts", lambda p: p["section"] < s), F.lit(0), lambda n, p: n + F.size(p["held"])),
    )
    places = places.select("_dv_block", before.alias("_dv_starts"), F.flatten("parts.held").alias("_dv_places"))
    places = stored(places)
    last = places.agg(F.max("_dv_block")).first()[0]
    blocks = removed.sparkSession.range(0 if last is None else last + 1).withColumnRenamed("id", "_dv_block")
    sized = blocks.join(places.select("_dv_block", F.size("_dv_places").alias("_size")), "_dv_block", "left").na.fill(0, ["_size"])
    ended = running_total(sized, ["_dv_block"], "_size", "_end")
    out = ended.select("_dv_block", (F.col("_end") - F.col("_size")).cast("long").alias("_dv_before")).join(places, "_dv_block", "left")
    return stored(out.select("_dv_block", "_dv_before", "_dv_starts", "_dv_places"))


def _counts(vector: DataFrame) -> tuple[int, int]:
    """Blocks and removals."""
    size = F.when(F.col("_dv_places").isNotNull(), F.size("_dv_places")).otherwise(0)
    found = vector.agg(F.count("*").alias("blocks"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    return found["blocks"], found["size"]


def _section(index: Column) -> tuple[Column, Column]:
    """The place of an index in its block, and the removals of its section."""
    place = (index % WIDTH).cast("int")
    section = F.floor(place / SECTION).cast("int")
    start, end = F.get("_dv_starts", section), F.get("_dv_starts", section + 1)
    return place, F.slice("_dv_places", start + 1, end - start)


def without_removed(df: DataFrame, vector: DataFrame, index: str = INDEX, keep: str | None = None) -> DataFrame:
    """The rows of ``df`` that are not removed, each index less the number of removed ones below it.

    ``keep`` names a column for the old index. The table is joined by block, and not shuffled where the vector is small.
    """
    blocks, removals = _counts(vector)
    side = F.broadcast(vector) if removals <= BROADCAST_REMOVALS and blocks <= BROADCAST_BLOCKS else vector
    place, near = _section(F.col("_dv_index"))
    below = F.when(F.col("_dv_before").isNull(), F.lit(removals)).otherwise(
        F.col("_dv_before")
        + F.when(F.col("_dv_places").isNull(), 0).otherwise(
            F.get("_dv_starts", F.floor(place / SECTION).cast("int")) + F.size(F.filter(near, lambda p: p < place))
        )
    )
    gone = F.col("_dv_places").isNotNull() & F.array_contains(near, place)
    own = [c for c in df.columns if c != index]
    placed = df.withColumns({"_dv_index": column(index).cast("long"), "_dv_block": F.floor(column(index) / WIDTH).cast("long")})
    left = placed.join(side, "_dv_block", "left").where(~gone)
    kept = [F.col("_dv_index").alias(keep)] if keep else []
    return left.select((F.col("_dv_index") - below).alias(index), *kept, *[column(c) for c in own])
