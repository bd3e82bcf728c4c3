"""A table stored by its row index: pages open a few files, edits are laid over it, and compaction folds them in.

Files hold contiguous ranges of rows, and a fence table tells the first and last row of each. Edits of cells, removed rows
and appended rows are written beside them and merged when rows are read, so an edit never rewrites the table. A row keeps
its number in the files, its *row id*, until the next compaction; its *row index* is its place among the rows that are left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.parsing import column
from tablewright.operators.deletions import WIDTH, deletion_vector, without_removed
from tablewright.operators.edits import append_rows, rejected_edits, update_cells
from tablewright.operators.ordering import MAX_PAGE_SIZE, PAGE_SIZE, mixed_order, with_mixed_keys
from tablewright.operators.rowindex import INDEX, dense_index

ID = "_row_id"
STATE = "seq bigint, parts array<string>, n_ids bigint, n_rows bigint, edits array<string>, removed string, n_edits bigint, views map<string,string>"
#: Points of an evenly spaced sample.
SAMPLE_POINTS, SAMPLE_ABOVE = 100, 150
#: A file has at most so many rows, which bounds what a page of one row has to open.
ROWS_PER_FILE = 1_000_000


class IndexedTable:
    """A stored table under ``root``. Each change adds a state; readers see the newest one, so a failed write shows nothing."""

    def __init__(self, spark: SparkSession, root: str, rows_per_file: int = ROWS_PER_FILE) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.rows_per_file = rows_per_file

    @classmethod
    def create(cls, df: DataFrame, root: str, order_by: list | None = None, rows_per_file: int = ROWS_PER_FILE) -> IndexedTable:
        """Stores ``df`` numbered by ``order_by``, or by its column ``row_index`` if it has one, which must be dense."""
        table = cls(df.sparkSession, root, rows_per_file)
        numbered = df if order_by is None and INDEX in df.columns else dense_index(df, order_by)
        table._write_base(numbered, in_order=order_by is not None or INDEX not in df.columns)
        return table

    # -- states

    def _path(self, kind: str) -> str:
        return f"{self.root}/{kind}/{uuid.uuid4().hex}"

    def _state(self):
        return self.spark.read.schema(STATE).parquet(f"{self.root}/states").orderBy(F.desc("seq")).first()

    def _advance(self, before=None, **changes) -> None:
        now = {f.split()[0]: None for f in STATE.split(", ")} if before is None else before.asDict()
        now.update(changes)
        now["seq"] = (before["seq"] if before is not None else 0) + 1
        fields = [f.split()[0] for f in STATE.split(", ")]
        self.spark.createDataFrame([tuple(now[f] for f in fields)], STATE).coalesce(1).write.mode("append").parquet(f"{self.root}/states")

    def _write_part(self, rows: DataFrame) -> tuple[str, int]:
        """Rows with their ids as files, and beside them the fences; the path and the number of rows."""
        path = self._path("rows")
        rows.write.option("maxRecordsPerFile", self.rows_per_file).parquet(path)
        written = self.spark.read.parquet(path)
        fences = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(ID).alias("low"), F.max(ID).alias("high"), F.count("*").alias("n"))
        fences.coalesce(1).write.parquet(f"{path}-fences")
        return path, self.spark.read.parquet(f"{path}-fences").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def _write_base(self, numbered: DataFrame, before=None, in_order: bool = True) -> None:
        """The whole table in contiguous ranges of rows, without edits."""
        if not in_order:
            numbered = numbered.repartitionByRange(column(INDEX)).sortWithinPartitions(column(INDEX))
        path, n = self._write_part(numbered.withColumnRenamed(INDEX, ID))
        self._advance(before, parts=[path], n_ids=n, n_rows=n, edits=[], removed=None, n_edits=0, views={})

    # -- reading

    def fences(self) -> DataFrame:
        """``(file, low, high, n)``: the row ids in each file."""
        return self._fences(self._state())

    def _fences(self, state) -> DataFrame:
        return self.spark.read.parquet(*[f"{p}-fences" for p in state["parts"]])

    def count(self) -> int:
        return self._state()["n_rows"]

    def _base(self, state, low: int | None = None, high: int | None = None, ids: list[int] | None = None) -> DataFrame:
        """Stored rows, of the files that hold row ids from ``low`` to ``high`` or any of ``ids``, filtered by them in the scan."""
        if low is None and ids is None:
            return self.spark.read.parquet(*state["parts"])
        if ids is not None:
            low, high = (min(ids), max(ids)) if ids else (0, -1)
        near = self._fences(state).where((F.col("high") >= low) & (F.col("low") <= high))
        if ids is not None:
            near = near.where(F.exists(F.array(*[F.lit(i) for i in ids]).cast("array<long>"), lambda i: i.between(F.col("low"), F.col("high"))))
        schema = self.spark.read.parquet(*state["parts"]).schema
        files = [r["file"] for r in near.select("file").collect()]  # files of one range
        found = self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)
        return found.where((F.col(ID) >= low) & (F.col(ID) <= high) if ids is None else _any_of(ids))

    def _merged(self, state, base: DataFrame) -> DataFrame:
        """Stored rows with the edits laid over them, numbered anew where rows were removed."""
        rows = base.withColumnRenamed(ID, INDEX)
        if state["edits"]:
            rows = update_cells(rows, self.spark.read.parquet(*state["edits"]))
        if state["removed"] is None:
            return rows
        return without_removed(rows, self.spark.read.parquet(state["removed"]))

    def rows(self) -> DataFrame:
        """All rows as they are now."""
        state = self._state()
        return self._merged(state, self._base(state))

    def _ids_of(self, state, start: int, stop: int) -> tuple[int, int]:
        """The least and greatest row id that rows ``start <= row_index < stop`` can have."""
        if state["removed"] is None:
            return start, stop - 1
        vector = self.spark.read.parquet(state["removed"])
        size = F.when(F.col("_dv_places").isNotNull(), F.size("_dv_places")).otherwise(0)
        ends = vector.select("_dv_block", "_dv_before", (F.col("_dv_before") + size).alias("after")).selectExpr("_dv_block", "_dv_before", "after", f"_dv_block * {WIDTH} - _dv_before AS live")
        # In a block that begins with ``live`` rows before it, an id exceeds its index by what was removed before it, and at most by
        # what was removed up to the end of the block.
        found = ends.agg(F.max(F.when(F.col("live") <= start, F.col("_dv_before"))), F.max(F.when(F.col("live") < stop, F.col("after")))).first()
        return start + (found[0] or 0), stop - 1 + (found[1] or 0)

    def viewport(self, start: int, stop: int) -> DataFrame:
        """Rows ``start <= row_index < stop``: the files of that range only, filtered in the scan."""
        state = self._state()
        rows = self._merged(state, self._base(state, *self._ids_of(state, max(start, 0), stop)))
        return rows if state["removed"] is None else rows.where((F.col(INDEX) >= start) & (F.col(INDEX) < stop))

    def page(self, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
        """Rows of a 1-based page."""
        if number < 1 or not 1 <= size <= MAX_PAGE_SIZE:
            raise ValueError(f"pages start at 1 and have 1 to {MAX_PAGE_SIZE} rows")
        return self.viewport((number - 1) * size, number * size)

    def stride(self, above: int = SAMPLE_ABOVE, target: int = SAMPLE_POINTS) -> DataFrame:
        """Every ``ceil(n / target)``-th row of a table of more than ``above`` rows, by a filter on row ids in the scan."""
        state = self._state()
        n = state["n_rows"]
        if n <= above:
            return self.rows()
        step = -(-n // target)
        if state["removed"] is not None:
            return self.rows().where(F.col(INDEX) % step == 0)
        return self._merged(state, self._base(state, ids=list(range(0, n, step))))

    # -- sorted views

    def _view(self, state, name: str, ascending: bool) -> DataFrame:
        """The stored permutation of a sort key: positions, and the row index that stands there."""
        key = f"{name} {'up' if ascending else 'down'}"
        views = dict(state["views"] or {})
        if key not in views:
            path = self._path("views")
            rows = with_mixed_keys(self.rows().select(INDEX, column(name)), name)
            order = [*mixed_order(ascending), column(INDEX)]
            dense_index(rows, order, "position").select("position", INDEX).write.parquet(path)
            views[key] = path
            self._advance(state, views=views)
        return self.spark.read.parquet(views[key])

    def sorted_page(self, name: str, number: int = 1, size: int = PAGE_SIZE, ascending: bool = True) -> DataFrame:
        """``position`` and the rows of a page of the table sorted by a column in mixed order, ties by row index.

        The first page of a sort key stores its permutation, which holds until the next edit; a page then reads its range
        of it and the files of its rows.
        """
        if number < 1 or not 1 <= size <= MAX_PAGE_SIZE:
            raise ValueError(f"pages start at 1 and have 1 to {MAX_PAGE_SIZE} rows")
        state = self._state()
        view = self._view(state, name, ascending)
        start = (number - 1) * size
        wanted = view.where((F.col("position") >= start) & (F.col("position") < start + size))
        places = {r[INDEX]: r["position"] for r in wanted.collect()}  # one page
        if state["removed"] is None:
            rows = self._merged(state, self._base(state, ids=sorted(places)))
        else:
            rows = self.rows().where(F.col(INDEX).isin(list(places)))
        shown = self.spark.createDataFrame([(p, i) for i, p in places.items()], f"position bigint, {INDEX} bigint")
        return shown.join(rows, INDEX).select("position", *[column(c) for c in rows.columns])

    # -- changes

    def _located(self, state, wanted: DataFrame) -> DataFrame:
        """Rows with a row index, by their row id; only the ids of the table are read."""
        if state["removed"] is None:
            return wanted.where(F.col(INDEX).between(0, state["n_ids"] - 1)).withColumn(ID, F.col(INDEX))
        ids = without_removed(self._base(state).select(F.col(ID).alias(INDEX)), self.spark.read.parquet(state["removed"]), keep=ID)
        return wanted.join(ids, INDEX)

    def update(self, edits: DataFrame) -> DataFrame:
        """Lays edits ``(row_index, column, value[, edit_no])`` over the table; returns those that cannot be made, with their reason.

        The last edit of a cell that can be made wins, within a call by ``edit_no``.
        """
        state = self._state()
        order = F.col("edit_no") if "edit_no" in edits.columns else F.lit(0)
        later = (F.lit(state["n_edits"] << 32).cast("long") + order.cast("long")).alias("edit_no")
        path = self._path("edits")
        self._located(state, edits).select(F.col(ID).alias(INDEX), "column", "value", later).write.parquet(path)
        self._advance(state, edits=[*state["edits"], path], n_edits=state["n_edits"] + 1, views={})
        return rejected_edits(self._merged(state, self._base(state)), edits)

    def delete(self, rows: list[int] | DataFrame) -> None:
        """Removes rows by their present index; indices that no row has are ignored."""
        state = self._state()
        if not isinstance(rows, DataFrame):
            rows = self.spark.createDataFrame([(r,) for r in sorted(set(rows))], f"{INDEX} bigint")
        gone = self._located(state, rows.select(INDEX).distinct()).select(F.col(ID).alias(INDEX))
        if state["removed"] is not None:
            gone = gone.unionByName(removed_ids(self.spark.read.parquet(state["removed"])))
        vector = deletion_vector(gone)
        path = self._path("removed")
        vector.write.parquet(path)
        size = F.when(F.col("_dv_places").isNotNull(), F.size("_dv_places")).otherwise(0)
        left = state["n_ids"] - self.spark.read.parquet(path).agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
        self._advance(state, removed=path, n_rows=left, views={})

    def append(self, rows: list[dict]) -> None:
        """Adds rows after the last one, as further files of the stored table."""
        state = self._state()
        empty = self._base(state).where("false").withColumnRenamed(ID, INDEX)
        new = append_rows(empty, rows).withColumn(INDEX, F.col(INDEX) + F.lit(state["n_ids"]))
        path, n = self._write_part(new.withColumnRenamed(INDEX, ID).coalesce(1))  # rows given by the driver
        self._advance(state, parts=[*state["parts"], path], n_ids=state["n_ids"] + n, n_rows=state["n_rows"] + n, views={})

    def compact(self) -> None:
        """Writes the rows as they are now as a new stored table without edits beside it."""
        self._write_base(self.rows(), self._state(), in_order=False)


def removed_ids(vector: DataFrame, index: str = INDEX) -> DataFrame:
    """The indices that a deletion vector holds."""
    places = vector.where("_dv_places is not null").select("_dv_block", F.explode("_dv_places").alias("_place"))
    return places.select((F.col("_dv_block") * WIDTH + F.col("_place")).alias(index))


def _any_of(ids: list[int]) -> Column:
    """A filter on some row ids that reaches the files: their range, and each of them."""
    found = F.lit(False)
    for i in ids:
        found = found | (F.col(ID) == i)
    return F.col(ID).between(min(ids, default=0), max(ids, default=-1)) & found
