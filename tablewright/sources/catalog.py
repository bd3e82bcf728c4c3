"""A catalog of datasets on a shared folder: append-only status records and versioned row tables."""

from __future__ import annotations

import os
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.cleaning import null_to_blank
from tablewright.operators.rowindex import INDEX, dense_index
from tablewright.sources.order import source_index, without_order
from tablewright.sources.readers import read_source

# The life of a dataset.
PENDING, PROCESSING, READY, ERROR = "pending", "processing", "ready", "error"

RECORD = (
    "dataset_id string, owner_id string, name string, original_name string, path string, file_type string, "
    "status string, error_message string, row_count bigint, col_count int, columns array<string>, "
    "size_bytes bigint, uploaded_at timestamp, processed_at timestamp, version string, deleted boolean, seq bigint"
)


class Catalog:
    """Datasets of several owners under one root folder.

    Every change appends one record; the current state of a dataset is its latest record. Rows are
    written to a new version folder first and become visible by the record that names it, so a
    failed write leaves the old version in place. Record files are folded into a snapshot of latest records whenever there are
    ``compact_at`` new ones, so the number of files does not grow with the number of changes; ``vacuum`` removes versions of
    rows that no latest record names.
    """

    def __init__(self, spark: SparkSession, root: str, compact_at: int = 64) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.compact_at = compact_at
        self._last_seq = 0

    # -- folders

    def _folder(self, path: str):
        """The file system of a path below the root, and the path as it knows it."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _entries(self, path: str) -> list:
        """File statuses of what lies in a folder, or nothing if there is none."""
        fs, target = self._folder(path)
        return list(fs.listStatus(target)) if fs.exists(target) else []

    def _remove(self, path: str) -> None:
        fs, target = self._folder(path)
        fs.delete(target, True)

    # -- records

    def _append(self, record: dict) -> None:
        self._last_seq = max(time.time_ns(), self._last_seq + 1)
        row = {**record, "seq": self._last_seq}
        fields = [part.split()[0] for part in RECORD.split(", ")]
        data = [tuple(row.get(f) for f in fields)]
        self.spark.createDataFrame(data, RECORD).coalesce(1).write.mode("append").parquet(f"{self.root}/records")
        written = max(self._snapshots().values(), default=-1)
        if sum(at > written for at in self._record_files().values()) >= self.compact_at:
            self.compact()

    def _record_files(self) -> dict[str, int]:
        """Record files and when they were written."""
        found = {e.getPath().toString(): e.getModificationTime() for e in self._entries(f"{self.root}/records")}
        return {path: at for path, at in found.items() if path.endswith(".parquet")}

    def _snapshots(self) -> dict[str, int]:
        """Whole snapshots and when they were finished."""
        folders = [e.getPath().toString() for e in self._entries(f"{self.root}/snapshots")]
        ends = {f: [e.getModificationTime() for e in self._entries(f) if e.getPath().getName() == "_SUCCESS"] for f in folders}
        return {f: at[0] for f, at in ends.items() if at}

    def _latest(self, files: list[str]) -> DataFrame:
        """The latest record of each dataset in these files, deleted ones too."""
        records = self.spark.read.schema(RECORD).parquet(*files) if files else self.spark.createDataFrame([], RECORD)
        return records.groupBy("dataset_id").agg(F.max_by(F.struct(*records.columns), "seq").alias("r")).select("r.*")

    def datasets(self) -> DataFrame:
        """Latest record of every dataset that is not deleted."""
        # Snapshots are listed last: what a compaction removes after the first listing is in a snapshot by then.
        files = self._record_files()
        return self._latest([*files, *self._snapshots()]).where(~F.coalesce("deleted", F.lit(False)))

    def compact(self) -> None:
        """Folds all records into one snapshot of latest records.

        Files that were folded in the time before are removed once the new snapshot is whole; those folded now stay until the next time, for
        readers that have listed them. Only files that the snapshot holds are removed. A record that stands twice counts once, so a
        run that is cut short does no harm.
        """
        records, snapshots = self._record_files(), self._snapshots()
        newest = max(snapshots.values(), default=-1)
        self._latest([*records, *snapshots]).write.parquet(f"{self.root}/snapshots/{uuid.uuid4().hex}")
        for path in [p for p, at in records.items() if at <= newest] + [p for p, at in snapshots.items() if at < newest]:
            self._remove(path)

    def vacuum(self, older_than_s: float = 7 * 24 * 3600) -> list[str]:
        """Removes versions of rows that no latest record names, if they were last written to ``older_than_s`` seconds ago or earlier.

        The age spares versions that are being written, and those that a reader may still have open. Returns their paths.
        """
        before = time.time() * 1000 - older_than_s * 1000
        # Versions first, then records: a version that is named meanwhile is kept.
        found = [
            (d.getPath().getName(), v.getPath().getName(), v.getPath().toString())
            for d in self._entries(f"{self.root}/rows")
            for v in self._entries(d.getPath().toString())
            if v.getModificationTime() <= before
        ]
        if not found:
            return []
        versions = self.spark.createDataFrame(found, "dataset_id string, version string, place string")
        unnamed = versions.join(self.datasets().select("dataset_id", "version"), ["dataset_id", "version"], "left_anti")
        dead = sorted(r["place"] for r in unnamed.select("place").collect())
        for path in dead:
            self._remove(path)
        return dead

    def _size(self, path: str) -> int:
        fs, target = self._folder(path)
        return fs.getContentSummary(target).getLength() if fs.exists(target) else 0

    def register(self, owner: str, path: str, name: str | None = None) -> str:
        """A new pending dataset; its name defaults to the file name."""
        original = os.path.basename(path.rstrip("/"))
        dataset_id = uuid.uuid4().hex
        self._append(
            {
                "dataset_id": dataset_id,
                "owner_id": owner,
                "name": name or original,
                "original_name": original,
                "path": path,
                "file_type": original.rsplit(".", 1)[-1].lower(),
                "status": PENDING,
                "error_message": "",
                "row_count": 0,
                "col_count": 0,
                "columns": [],
                "size_bytes": self._size(path),
                "uploaded_at": datetime.now(timezone.utc),
                "deleted": False,
            }
        )
        return dataset_id

    def detail(self, dataset_id: str, owner: str) -> Row:
        found = self.datasets().where((F.col("dataset_id") == dataset_id) & (F.col("owner_id") == owner)).first()
        if found is None:
            raise LookupError("dataset not found")
        return found

    def list(self, owner: str) -> DataFrame:
        """The owner's datasets, newest first, with their size in MB."""
        mine = self.datasets().where(F.col("owner_id") == owner)
        return mine.withColumn("size_mb", F.round(F.col("size_bytes") / 1024 / 1024, 2)).orderBy(
            F.desc("uploaded_at"), F.desc("seq")
        )

    def search(self, users: DataFrame, text: str = "", status: str | None = None, file_type: str | None = None) -> DataFrame:
        """Datasets by status, type and a text in their name or their owner's name."""
        found = with_owner(self.datasets(), users)
        if status:
            found = found.where(F.col("status") == status)
        if file_type:
            found = found.where(F.col("file_type") == file_type)
        needle = F.lit(text.lower())
        return found.where(F.contains(F.lower("name"), needle) | F.contains(F.lower(F.coalesce("username", F.lit(""))), needle))

    def _change(self, record: Row, **changes) -> None:
        self._append({**record.asDict(), **changes})

    # -- rows

    def _rows_path(self, dataset_id: str, version: str) -> str:
        return f"{self.root}/rows/{dataset_id}/{version}"

    def ingest(self, dataset_id: str, owner: str, order_by: list[str] | None = None, **options) -> Row:
        """Reads the registered file, numbers and stores its rows: processing, then ready or error.

        Rows are numbered by ``order_by``, or else as they stand in their files.
        """
        record = self.detail(dataset_id, owner)
        self._change(record, status=PROCESSING, error_message="")
        try:
            table, in_place = read_source(self.spark, record["path"], **options)
            self._store(record, dense_index(without_order(table), order_by) if order_by else source_index(table, in_place))
        except Exception as error:
            self._change(record, status=ERROR, error_message=str(error))
            raise
        return self.detail(dataset_id, owner)

    def save(self, dataset_id: str, owner: str, table: DataFrame) -> Row:
        """Replaces the rows by an edited table; missing cells are stored as empty text."""
        record = self.detail(dataset_id, owner)
        self._store(record, null_to_blank(table))
        return self.detail(dataset_id, owner)

    def _store(self, record: Row, table: DataFrame) -> None:
        version = uuid.uuid4().hex
        path = self._rows_path(record["dataset_id"], version)
        table.write.mode("errorifexists").parquet(path)
        columns = [c for c in table.columns if c != INDEX]
        self._change(
            record,
            status=READY,
            error_message="",
            version=version,
            columns=columns,
            col_count=len(columns),
            # Counted from the footers of the files just written.
            row_count=self.spark.read.parquet(path).count(),
            processed_at=datetime.now(timezone.utc),
        )

    def rows(self, dataset_id: str, owner: str) -> DataFrame:
        """The current rows; an error unless the dataset is ready and holds rows."""
        record = self.detail(dataset_id, owner)
        if record["status"] != READY:
            raise ValueError(f"dataset is not ready (status: {record['status']})")
        if record["row_count"] == 0:
            raise ValueError("dataset is empty")
        return self.spark.read.parquet(self._rows_path(dataset_id, record["version"]))

    def delete(self, dataset_id: str, owner: str) -> None:
        """Marks the dataset deleted and removes all versions of its rows."""
        record = self.detail(dataset_id, owner)
        self._change(record, deleted=True)
        self._remove(f"{self.root}/rows/{dataset_id}")


def with_owner(datasets: DataFrame, users: DataFrame, key: str = "owner_id", user_key: str = "owner_id") -> DataFrame:
    """Adds the owner's columns; Spark broadcasts the users if their size allows it."""
    if key == user_key:
        return datasets.join(users, key, "left")
    return datasets.join(users, F.col(key) == F.col(user_key), "left")


def without_datasets(rows: DataFrame, dead: DataFrame, key: str) -> DataFrame:
    """Bulk cascade: rows whose dataset is not among the deleted ones."""
    return rows.join(dead.select(key), key, "left_anti")
