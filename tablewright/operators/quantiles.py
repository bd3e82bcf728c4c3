"""Exact order statistics for groups of any size.

``percentile`` keeps every distinct value of a group in one task. Here that is allowed only for
groups up to a stated size. For larger groups the wanted ranks are first narrowed to small value
intervals: each round counts the values of an interval in equal-width buckets (a plain aggregate
with partial sums on the map side) and keeps the buckets that hold a rank. What is left is counted
per value and numbered by the partitioned running total, so no task ever holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators.rowindex import running_total
from tablewright.session import broadcast_if_small, cut

# Values one task may hold for a group; without groups there is a single such buffer.
GROUP_LIMIT = 250_000
WHOLE_LIMIT = 1_000_000
BUCKETS = 1024
ROUNDS = 3


def exact_quantiles(
    df: DataFrame,
    value: Column,
    probs: list[float],
    by: list[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Per group: the columns of ``by``, ``n`` and ``quantiles`` (linear interpolation, as ``percentile``).

    Rows without a value or a group are left out.
    """
    by = by or []
    limit = limit or (GROUP_LIMIT if by else WHOLE_LIMIT)
    number = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    rows = df.select(*by, number.alias("_v"))
    if by:
        rows = rows.na.drop(subset=by)
    # The number of table rows is an upper bound that a Parquet scan takes from file footers.
    if df.count() <= limit:
        return _direct(rows, probs, by)
    rows = rows.where("_v is not null")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # At most one row per ``limit`` rows of the table.
    large = cut(sizes.where(F.col("n") > limit))
    if large.isEmpty():
        return _direct(rows, probs, by)
    ranked = _ranked(rows, large, probs, by, limit)
    if not by:
        return ranked
    small = rows.join(broadcast_if_small(large.select(*by)), by, "left_anti")
    return _direct(small, probs, by).unionByName(ranked)


def exact_median(df: DataFrame, value: Column, limit: int | None = None) -> DataFrame:
    """One row: ``n`` and ``median``."""
    found = exact_quantiles(df, value, [0.5], limit=limit)
    return found.select("n", F.element_at("quantiles", 1).alias("median"))


def _direct(rows: DataFrame, probs: list[float], by: list[str]) -> DataFrame:
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    found = rows.groupBy(*by).agg(F.count("_v").alias("n"), F.percentile("_v", wanted).alias("quantiles"))
    return found.where("n > 0") if by else found


def _spot(p: float) -> Column:
    """The fractional 0-based rank of a quantile."""
    return (F.col("n") - 1) * F.lit(float(p))


def _ranked(rows: DataFrame, large: DataFrame, probs: list[float], by: list[str], limit: int) -> DataFrame:
    ends = [side(_spot(p)) for p in probs for side in (F.floor, F.ceil)]
    # Disjoint intervals of a group: _inside values lie in [_lo, _hi], _below values under _lo, and
    # the values of the 0-based _ranks are among them.
    state = large.select(
        *by, "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("n").alias("_inside"), F.array_distinct(F.array(*ends)).alias("_ranks")
    )
    is_open = (F.col("_inside") > limit) & (F.col("_lo") < F.col("_hi"))
    for _ in range(ROUNDS):
        if state.where(is_open).isEmpty():
            break
        state = cut(state.where(~is_open).unionByName(_narrow(rows, state.where(is_open), by)))
    found = F.map_from_entries(F.collect_list(F.struct("_rank", "_at"))).alias("_at")  # two per quantile
    ranks = _select(rows, state, by)
    if by:
        joined = large.join(ranks.groupBy(*by).agg(found), by)
    else:
        joined = large.withColumn("_at", ranks.agg(found).scalar())
    out = []
    for p in probs:
        a, b = F.col("_at")[F.floor(_spot(p))], F.col("_at")[F.ceil(_spot(p))]
        # The arithmetic of ``percentile``, so that the size of a group decides no digit.
        between = (F.ceil(_spot(p)) - _spot(p)) * a + (_spot(p) - F.floor(_spot(p))) * b
        out.append(F.when(a == b, a).otherwise(between))
    return joined.select(*by, "n", F.array(*out).alias("quantiles"))


def _inside(rows: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, _v, _lo, _hi)``: rows that lie in an interval of their group, at most one each.

    Intervals are broadcast while they are few; beyond that Spark splits skewed partitions. Without
    groups the handful of intervals is a literal.
    """
    if by:
        near = broadcast_if_small(state.select(*by, "_lo", "_hi"))
        return rows.join(near, by).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    ends = [F.struct(F.lit(r["_lo"]).alias("_lo"), F.lit(r["_hi"]).alias("_hi")) for r in state.select("_lo", "_hi").collect()]
    intervals = F.array(*ends).cast("array<struct<_lo:double,_hi:double>>")
    hits = F.filter(intervals, lambda s: F.col("_v").between(s["_lo"], s["_hi"]))
    return rows.select("_v", F.explode(hits).alias("_s")).select("_v", "_s._lo", "_s._hi")


def _narrow(rows: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """One round: the buckets that hold a wanted rank, with the exact ends of their values."""
    keys = [*by, "_lo"]
    width = F.col("_hi") - F.col("_lo")
    # Rounding keeps the order, so buckets follow the order of the values. An infinite width says
    # nothing about the place of a value; such an interval is left to the final numbering.
    place = F.floor((F.col("_v") - F.col("_lo")) / width * BUCKETS)
    bucket = F.when(width < float("inf"), F.least(place, F.lit(BUCKETS - 1))).otherwise(0)
    pieces = (
        _inside(rows, state, by)
        .groupBy(*keys, bucket.alias("_bucket"))
        .agg(F.count("*").alias("_count"), F.min("_v").alias("_first"), F.max("_v").alias("_last"))
    )
    # At most BUCKETS rows per interval.
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = pieces.withColumn("_before", F.coalesce(F.sum("_count").over(earlier), F.lit(0)))
    start = F.col("_below") + F.col("_before")
    held = F.filter("_ranks", lambda r: (r >= start) & (r < start + F.col("_count")))
    return (
        counted.join(state.select(*keys, "_below", "_ranks"), keys)
        .withColumn("_held", held)
        .where(F.size("_held") > 0)
        .select(
            *by,
            F.col("_first").alias("_lo"),
            F.col("_last").alias("_hi"),
            start.alias("_below"),
            F.col("_count").alias("_inside"),
            F.col("_held").alias("_ranks"),
        )
    )


def _select(rows: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, _rank, _at)``: the value of each wanted rank."""
    keys = [*by, "_lo"]
    settled = state.where(F.col("_lo") == F.col("_hi"))
    done = settled.select(*by, F.explode("_ranks").alias("_rank"), F.col("_lo").alias("_at"))
    rest = state.where(F.col("_lo") < F.col("_hi"))
    if rest.isEmpty():
        return done
    # Unique (interval, value) pairs, so the range partitions of the running total cannot be skewed.
    values = _inside(rows, rest, by).groupBy(*keys, "_v").agg(F.count("*").alias("_count"))
    ended = running_total(values, [*keys, "_v"], "_count", "_end")
    starts = ended.groupBy(*keys).agg(F.min(F.col("_end") - F.col("_count")).alias("_start"))
    to = F.col("_below") + F.col("_end") - F.col("_start")
    held = F.filter("_ranks", lambda r: (r >= to - F.col("_count")) & (r < to))
    picked = ended.join(rest.select(*keys, "_below", "_ranks").join(starts, keys), keys)
    return done.unionByName(picked.select(*by, F.explode(held).alias("_rank"), F.col("_v").alias("_at")))
