"""Cleaners over the whole table, and the log of what they changed."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.formatting import cell_text
from tablewright.functions.parsing import column, is_text_type
from tablewright.operators.rowindex import INDEX

_INCOMPARABLE = (T.MapType, T.VariantType)


def trimmed(text: Column) -> Column:
    """Without leading and trailing white space of any kind (``trim`` removes spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text_type(f.dataType)]


def trim_whitespace(df: DataFrame) -> DataFrame:
    """Trims every text cell; missing cells stay missing."""
    return df.withColumns({c: trimmed(column(c)) for c in _text_columns(df)})


def fill_empty(df: DataFrame, fill: str = "0") -> DataFrame:
    """Blank and missing cells become ``fill``; other text is trimmed, other types only filled."""
    filled = {}
    for f in df.schema.fields:
        c = column(f.name)
        if is_text_type(f.dataType):
            text = trimmed(c)
            filled[f.name] = F.when(c.isNull() | (text == ""), F.lit(fill)).otherwise(text)
        elif isinstance(f.dataType, T.NumericType):
            filled[f.name] = F.coalesce(c, F.lit(fill).try_cast(f.dataType))
    return df.withColumns(filled)


def null_to_blank(df: DataFrame, index: str = INDEX) -> DataFrame:
    """Every cell as text, missing ones as the empty text; numbers as a sheet shows them, without an exponent."""
    kept = [c for c in df.columns if c == index]
    return df.select(*kept, *[F.coalesce(cell_text(df, c), F.lit("")).alias(c) for c in df.columns if c != index])


def remove_duplicates(df: DataFrame, index: str = INDEX) -> DataFrame:
    """Keeps the first row (smallest ``index``) of equal rows.

    A plain aggregate: duplicates of a hot row collapse on the map side, before the shuffle. Columns
    that Spark cannot compare are compared as JSON and read back from the first row's copy.
    """
    data = [f for f in df.schema.fields if f.name != index]
    odd = [f.name for f in data if isinstance(f.dataType, _INCOMPARABLE)]
    keys = [F.to_json(column(f.name)) if f.name in odd else column(f.name) for f in data]
    found = [F.min(index).alias(index)]
    if odd:
        found.append(F.min_by(F.struct(*[column(c) for c in odd]), F.col(index)).alias("_first"))
    kept = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*found)
    source = {
        f.name: F.col("_first")[f.name] if f.name in odd else F.col(f"_k{i}") for i, f in enumerate(data)
    }
    return kept.select(*[source.get(c, F.col(index)).alias(c) for c in df.columns])


def cells_to_trim(df: DataFrame) -> Column:
    """How many cells trimming changes, as an aggregate."""
    return _total([F.count_if(trimmed(column(c)) != column(c)) for c in _text_columns(df)])


def cells_to_fill(df: DataFrame) -> Column:
    """How many blank or missing cells filling changes, as an aggregate."""
    texts = [F.count_if(column(c).isNull() | (trimmed(column(c)) == "")) for c in _text_columns(df)]
    numbers = [F.count_if(column(f.name).isNull()) for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return _total(texts + numbers)


def _total(counts: list[Column]) -> Column:
    total = F.count_if(F.lit(False))
    for c in counts:
        total = total + c
    return total


# What the log says of the cleaning steps.
MESSAGES = {
    "trim": "Trimmed whitespace",
    "fill_empty": "Filled empty cells with 0",
    "remove_duplicates": "Removed {removed} duplicates",
    "uppercase_columns": "Columns uppercased",
}


class ActivityLog:
    """Counts what each cleaning step sees and changes while the steps run, without extra jobs.

    Wrap steps with :meth:`apply`; after the result was written or collected, :meth:`frame` gives
    ``(step, op, rows_in, rows_out, cells_changed)`` and :meth:`entries` the log as shown, newest first.
    """

    def __init__(self) -> None:
        self._steps: list[tuple[str, str, datetime, Observation, Observation]] = []

    def apply(self, df: DataFrame, op: str, step, changes=None, message: str | None = None) -> DataFrame:
        """``changes`` maps the input to an aggregate such as :func:`cells_to_trim`; ``message`` is what the log says of the step, with
        ``{removed}`` for the number of rows that it took away."""
        before, after = Observation(), Observation()
        self._steps.append((op, message or MESSAGES.get(op, op), datetime.now(timezone.utc), before, after))
        counted = [F.count(F.lit(1)).alias("rows")] + ([changes(df).alias("cells")] if changes else [])
        seen = df.observe(before, *counted)
        return step(seen).observe(after, F.count(F.lit(1)).alias("rows"))

    def frame(self, spark) -> DataFrame:
        rows = [
            (i, op, before.get["rows"], after.get["rows"], before.get.get("cells"))
            for i, (op, _, _, before, after) in enumerate(self._steps)
        ]
        return spark.createDataFrame(rows, "step int, op string, rows_in bigint, rows_out bigint, cells_changed bigint")

    def entries(self, spark) -> DataFrame:
        """``(position, time, message, removed, changed)`` of every step, the newest at position 0."""
        rows = [
            (i, at, message.replace("{removed}", str(removed)), removed, before.get.get("cells"))
            for i, (_, message, at, before, after) in enumerate(reversed(self._steps))
            for removed in [before.get["rows"] - after.get["rows"]]
        ]
        return spark.createDataFrame(rows, "position int, time timestamp, message string, removed bigint, changed bigint")


def cleaning_counts(df: DataFrame) -> DataFrame:
    """Per text column: ``(col, untrimmed, blank, missing)``; how many cells the cleaners would touch."""
    names = _text_columns(df)
    aggs, entries = [], []
    for i, name in enumerate(names):
        c = column(name)
        aggs += [
            F.count_if(trimmed(c) != c).alias(f"t{i}"),
            F.count_if(trimmed(c) == "").alias(f"b{i}"),
            F.count_if(c.isNull()).alias(f"m{i}"),
        ]
        entries.append(
            F.struct(
                F.lit(name).alias("col"),
                F.col(f"t{i}").alias("untrimmed"),
                F.col(f"b{i}").alias("blank"),
                F.col(f"m{i}").alias("missing"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*entries)))
