"""Delimited text at any size: cells may hold line breaks, and files are still cut into blocks that are read in parallel.

Where a block begins it is not known whether a quoted cell is open. Each line is therefore judged for both cases, and a block
is summed up as what it makes of either. Going through the blocks of a file, a few bits each, then tells the true case of
every block; lines are joined to records within their block, and only the record that crosses into the next block is
put together in a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.functions.names import clean_names
from tablewright.functions.parsing import numeric
from tablewright.session import broadcast_if_small, stored
from tablewright.sources.order import BLOCK, FILE, LATE, PLACE, block_columns

RECORD = "_record"

_PIECE = f"{FILE} string, {BLOCK} long, {PLACE} long, {RECORD} string, part byte"
#: What a piece of text is: a whole record; the end of one begun in an earlier block; one left open; a block within one.
_WHOLE, _ENDS, _BEGINS, _INSIDE = 0, 1, 2, 3


def _field(sep: str) -> str:
    """A cell as a pattern: quoted, with doubled quotes and what may follow the closing one, or plain."""
    other = f"(?:(?!{re.escape(sep)})[\\s\\S])*+"
    return f'(?:"[^"]*+(?:""[^"]*+)*+"(?!"){other}|(?!"){other})'


def _closed(sep: str) -> tuple[str, str]:
    """Patterns of lines that end outside quotes: one that begins outside them, one that begins inside."""
    cut, field = re.escape(sep), _field(sep)
    rest = f"(?:{cut}{field})*+"
    after = f"(?:(?!{cut})[\\s\\S])*+"
    return f"^{field}{rest}$", f'^[^"]*+(?:""[^"]*+)*+"(?!"){after}{rest}$'


def cells(line: Column, sep: str = ",") -> Column:
    """The cells of one record as an array of text; quotes are taken off, and empty cells are NULL."""
    plain = F.split(line, F.lit(re.escape(sep)), -1)
    pattern = f'{re.escape(sep)}({_field(sep)}|"[\\s\\S]*+)'
    quoted = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(pattern), F.lit(1))
    body = r'^"([^"]*+(?:""[^"]*+)*+)"?([\s\S]*)$'

    def bare(cell: Column) -> Column:
        inner = F.concat(F.replace(F.regexp_extract(cell, body, 1), F.lit('""'), F.lit('"')), F.regexp_extract(cell, body, 2))
        return F.when(F.startswith(cell, F.lit('"')), inner).otherwise(cell)

    found = F.when(F.contains(line, F.lit('"')), F.transform(quoted, bare)).otherwise(plain)
    return F.transform(found, lambda c: F.nullif(c, F.lit("")))


def text_lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Lines with their place, and whether they leave a cell open (1) if none (``from_0``) or one (``from_1``) was open before."""
    lines = spark.read.option("lineSep", "\n").text(path).select(*block_columns(), F.monotonically_increasing_id().alias(PLACE), "value")
    outside, inside = _closed(sep)
    quotes = F.contains("value", F.lit('"'))
    return lines.withColumns(
        {
            "from_0": F.when(quotes, (~F.rlike("value", F.lit(outside))).cast("byte")).otherwise(F.lit(0).cast("byte")),
            "from_1": F.when(quotes, (~F.rlike("value", F.lit(inside))).cast("byte")).otherwise(F.lit(1).cast("byte")),
        }
    )


def _summed_up(batches: Iterator) -> Iterator:
    """Per block: where either start leads, whether it is left open somewhere on the way, and whether an open cell never closes.

    Lines of a block come one after the other in one task, so a task keeps a few numbers.
    """
    import numpy as np
    import pyarrow as pa

    names = ["_file", "_block", "to_0", "to_1", "open_0", "open_1", "inside", "header"]
    kinds = [pa.string(), pa.int64(), pa.int8(), pa.int8(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64()]

    def row(block, s):
        values = [*block, s[0], s[1], s[2], s[3], s[4], s[5]]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    now, s = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block, place, from_0, from_1, filled = batch.columns
        blocks, f0, f1 = block.to_numpy(), from_0.to_numpy(), from_1.to_numpy()
        filled = filled.to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(file.dictionary_encode().indices.to_numpy()) != 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)], strict=True):
            here = (file[a].as_py(), int(blocks[a]))
            if here != now:
                if now is not None:
                    yield row(now, s)
                now, s = here, [0, 1, False, False, True, None]
            after = [_states(f0[a:b], f1[a:b], s[start]) for start in (0, 1)]
            s[:5] = [*(int(x[-1]) for x in after), *(s[2 + i] or bool(x.any()) for i, x in enumerate(after)), s[4] and bool(after[1].all())]
            if s[5] is None and filled[a:b].any():
                s[5] = place[a + int(filled[a:b].argmax())].as_py()
    if now is not None:
        yield row(now, s)


def _states(from_0, from_1, start: int):
    """Whether a cell is open after each line: as the last line says that leads to one state, swapped by each swapping line since."""
    import numpy as np

    swaps = np.cumsum((from_0 == 1) & (from_1 == 0))
    last = np.maximum.accumulate(np.where(from_0 == from_1, np.arange(len(from_0)), -1))
    return np.where(last >= 0, from_0[last] + swaps - swaps[last], start + swaps) % 2


def _blocks(lines: DataFrame) -> DataFrame:
    """One row per block: ``start`` (1 if a cell is open where it begins), ``finish``, ``opens`` and ``owner``, the block in
    which the record open at its start begins."""
    filled = (F.trim(F.replace("value", F.lit("\r"))) != "").alias("filled")
    schema = "_file string, _block long, to_0 byte, to_1 byte, open_0 boolean, open_1 boolean, inside boolean, header long"
    found = stored(lines.select(FILE, BLOCK, PLACE, "from_0", "from_1", filled).mapInArrow(_summed_up, schema))
    # A block leads to one state, keeps the state, or swaps it. The state before a block is that of the last block that leads
    # to one, swapped as often as blocks since then do so.
    upto = Window.partitionBy(FILE).orderBy(BLOCK)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    fixed, swaps = F.col("to_0") == F.col("to_1"), F.when((F.col("to_0") == 1) & (F.col("to_1") == 0), 1).otherwise(0)
    counted = found.withColumn("swaps", F.sum(swaps).over(upto))
    last = F.last(F.when(fixed, F.struct("to_0", "swaps")), ignorenulls=True).over(before)
    known = counted.withColumn("last", last).withColumn("swapped", F.coalesce(F.lag("swaps").over(upto), F.lit(0)))
    start = F.when(F.col("last").isNull(), F.col("swapped") % 2).otherwise((F.col("last.to_0") + F.col("swapped") - F.col("last.swaps")) % 2)
    placed = known.withColumn("start", start.cast("byte"))
    finish, opens = [F.when(F.col("start") == 1, F.col(b)).otherwise(F.col(a)) for a, b in (("to_0", "to_1"), ("open_0", "open_1"))]
    begun = F.when((finish == 1) & ((F.col("start") == 0) | ~F.col("inside")), F.col(BLOCK))
    return placed.select(FILE, BLOCK, "start", finish.alias("finish"), opens.alias("opens"), "header", F.last(begun, ignorenulls=True).over(before).alias("owner"))


def _joined(batches: Iterator) -> Iterator:
    """Lines as records: those of one record are joined by line breaks; what crosses an end of the block stays a piece."""
    import numpy as np
    import pyarrow as pa

    def pieces(rows):
        names = ["_file", "_block", "_line", "_record", "part"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int8()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    now, state, held = None, 0, None  # block, open cell, and the record begun: (file, block, place, lines, begun here)
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block, place, from_0, from_1, start, value = batch.columns
        blocks = block.to_numpy()
        files = file.dictionary_encode().indices.to_numpy()
        edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(files) != 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            here, out = (file[a].as_py(), block[a].as_py()), []
            if here != now:
                if held is not None:  # open where its block ended
                    out.append((*held[:3], "\n".join(held[3]), 2 if held[4] else 3))
                now, state, held = here, start[a].as_py(), None
                if state:
                    held = (*here, place[a].as_py(), [], False)
            f0, f1 = from_0.slice(a, b - a).to_numpy(), from_1.slice(a, b - a).to_numpy()
            if state == 0 and not f0.any():
                part = batch.slice(a, b - a)
                if out:
                    yield pieces(out)
                yield pa.RecordBatch.from_arrays([*[part.column(i).cast(k) for i, k in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()), (6, pa.string()))], pa.array(np.zeros(b - a, np.int8))], ["_file", "_block", "_line", "_record", "part"])
                continue
            for at, line, end_0, end_1 in zip(place.slice(a, b - a).to_pylist(), value.slice(a, b - a).to_pylist(), f0.tolist(), f1.tolist(), strict=True):
                if held is None:
                    held = (*here, at, [], True)
                held[3].append(line)
                state = end_1 if state else end_0
                if not state:
                    out.append((*held[:3], "\n".join(held[3]), 0 if held[4] else 1))
                    held = None
            yield pieces(out)
    if held is not None:
        yield pieces([(*held[:3], "\n".join(held[3]), 2 if held[4] else 3)])


def _crossing(pieces: DataFrame, blocks: DataFrame) -> DataFrame:
    """Records that cross blocks, put together in the block in which they begin."""
    named = pieces.join(blocks.select(FILE, BLOCK, "owner"), [FILE, BLOCK])
    whose = F.when(F.col("part") == _BEGINS, F.col(BLOCK)).otherwise(F.col("owner"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(BLOCK), F.col(PLACE), F.col(RECORD))))  # the blocks of one record
    found = named.groupBy(FILE, whose.alias("whose")).agg(parts.alias("parts"), F.min(F.when(F.col("part") == _BEGINS, F.col(PLACE))).alias(PLACE))
    return found.select(FILE, F.col("whose").alias(BLOCK), PLACE, F.array_join(F.col(f"parts.{RECORD}"), "\n").alias(RECORD), F.lit(True).alias(LATE))


def records(spark: SparkSession, path: str, sep: str = ",") -> tuple[DataFrame, str]:
    """Records ``(_file, _block, _place, _late, _record)`` of all files but headers and blank ones, and the header.

    Quotes count only where a cell begins with one, and are doubled inside; a cell may hold separators and line breaks. Every
    file begins with the same header, its first line that is not blank. A quoted cell that never closes is an error, as
    are headers that differ and a table without a header.
    """
    lines = text_lines(spark, path, sep)
    blocks = stored(_blocks(lines))
    ends = blocks.groupBy(FILE).agg(F.max_by("finish", BLOCK).alias("finish"), F.max("opens").alias("opens"), F.min(F.when(F.col("header").isNotNull(), F.struct(BLOCK, F.col("header").alias(PLACE)))).alias("at"))
    headers = stored(ends.select(FILE, "finish", "opens", "at.*"))
    seen = headers.agg(F.max("finish").alias("finish"), F.max("opens").alias("opens"), F.max_by(FILE, "finish").alias("file"), F.count(BLOCK).alias("filled")).first()
    if not seen["filled"]:
        raise ValueError("the file is empty")
    if seen["finish"]:
        raise ValueError(f"a quoted cell of {seen['file']} never closes")

    if not seen["opens"]:
        found = lines.select(FILE, BLOCK, PLACE, F.col("value").alias(RECORD), F.lit(False).alias(LATE))
    else:
        inside = blocks.where("start = 1").select(FILE, BLOCK, "start")
        known = broadcast_if_small(inside)
        started = lines.join(known, [FILE, BLOCK], "left")
        if known is inside:  # too many to broadcast: the join deals lines out anew, so each block is put in order again
            started = started.repartition(FILE, BLOCK).sortWithinPartitions(FILE, BLOCK, PLACE)
        asked = started.select(FILE, BLOCK, PLACE, "from_0", "from_1", F.coalesce("start", F.lit(0)).cast("byte").alias("start"), "value")
        pieces = asked.mapInArrow(_joined, _PIECE)
        found = pieces.where(F.col("part") == _WHOLE).select(FILE, BLOCK, PLACE, RECORD, F.lit(False).alias(LATE))
        if blocks.where("finish = 1").limit(1).count():
            crossing = stored(pieces.where(F.col("part") != _WHOLE))  # two pieces of a block at most; else each use would read all lines again
            found = found.unionByName(_crossing(crossing, blocks))
    found = found.withColumn(RECORD, F.regexp_replace(RECORD, r"\r$", "")).where(F.trim(RECORD) != "")
    heads = headers.where(F.col(PLACE).isNotNull()).select(FILE, BLOCK, PLACE)
    heads = broadcast_if_small(heads)
    first = lines.join(heads, [FILE, BLOCK, PLACE], "left_semi").select(FILE, F.regexp_replace("value", r"\r$", "").alias(RECORD), "from_0")
    if not first.where("from_0 = 1").isEmpty():  # a name holds a line break
        first = found.join(heads, [FILE, BLOCK, PLACE], "left_semi")
    shown = first.agg(F.min_by(RECORD, FILE).alias("header"), F.min(RECORD).alias("low"), F.max(RECORD).alias("high")).first()
    if shown["low"] != shown["high"]:
        raise ValueError("the files have different headers")
    return found.join(heads, [FILE, BLOCK, PLACE], "left_anti"), shown["header"].removeprefix("\ufeff")


def delimited_table(spark: SparkSession, path: str, sep: str = ",", typed: bool = False) -> DataFrame:
    """The columns of delimited files, and the places of their rows.

    A row with more cells than the header gives further columns, named by their position; cells that a
    short row lacks are NULL. With ``typed`` columns that are entirely numeric become DOUBLE. The number of columns and their types
    come from one aggregate by position.
    """
    found, header = records(spark, path, sep)
    split = found.select(FILE, BLOCK, PLACE, LATE, cells(F.col(RECORD), sep).alias("cells"))
    names = [c or "" for c in spark.range(1).select(cells(F.lit(header), sep)).first()[0]]
    by_place = split.select(F.posexplode("cells").alias("i", "cell")).groupBy("i").agg(F.count("cell").alias("n"), F.count(numeric(F.col("cell"))).alias("numbers"))
    seen = {r["i"]: r for r in by_place.collect()}  # one row for each column
    names = clean_names([*names, *[""] * (max(seen, default=-1) + 1 - len(names))])

    def cell(i: int) -> Column:
        c = F.get("cells", F.lit(i))
        whole = i not in seen or seen[i]["n"] == seen[i]["numbers"]
        return (numeric(c) if typed and whole else c).alias(names[i])

    return split.select(*[cell(i) for i in range(len(names))], FILE, BLOCK, PLACE, LATE)
