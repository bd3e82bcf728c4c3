"""Incremental ingest: files that arrive in a folder become indexed rows of one dataset; files that cannot be read are set aside."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tablewright.functions.names import clean_names
from tablewright.operators.cleaning import trim_whitespace
from tablewright.operators.rowindex import INDEX
from tablewright.sources.catalog import ERROR, READY
from tablewright.sources.order import FILE, ORDER, placed, source_index

BATCH = "batch"
SOURCE = "_source_file"
STATUS = "batch_id bigint, file string, status string, error_message string, n_rows bigint"
FILES = "path string, modificationTime timestamp, length bigint, content binary"
OFFSETS = "batch_id bigint, first_index bigint, next_index bigint"


def ingest_folder(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    target: str,
    checkpoint: str,
    fmt: str = "json",
    options: dict | None = None,
    files_per_batch: int = 1000,
    trim: bool = False,
) -> StreamingQuery:
    """Starts a query that takes in all files present, batch by batch, and then stops.

    The stream is one of files. Those of a micro-batch are read together, their rows numbered by file and place after the rows of all earlier
    batches, and written to the batch's own folder, so a batch that is replayed after a failure leaves the same
    rows. If that fails, files are tried in halves until the ones that cannot be read alone are found; they get the status ``error`` with its
    message and the others go in. A failure that no file repeats is not the files' and stops the query.
    """
    given = {"mode": "FAILFAST", **(options or {})}
    stream = (
        spark.readStream.format("binaryFile").schema(FILES).options(**(options or {})).option("maxFilesPerTrigger", files_per_batch).load(source).select("path")
    )

    def table_of(files: list[str]) -> DataFrame:
        scan = spark.read.format(fmt).schema(schema).options(**given).load(files)
        rows = placed(scan).toDF(*clean_names(scan.columns), *ORDER)
        return rows.withColumn(SOURCE, F.col(FILE))

    def write(files: list[str], folder: str, start: int) -> None:
        numbered = source_index(table_of(files))
        if trim:
            numbered = trim_whitespace(numbered)
        numbered.withColumn(INDEX, F.col(INDEX) + start).write.mode("overwrite").parquet(folder)

    def fault(files: list[str]) -> str | None:
        try:
            table_of(files).write.format("noop").mode("overwrite").save()
        except Exception as error:
            return str(error)
        return None

    def unreadable(files: list[str]) -> dict[str, str]:
        message = fault(files)
        if message is None:
            return {}
        if len(files) == 1:
            return {files[0]: message}
        half = len(files) // 2
        return {**unreadable(files[:half]), **unreadable(files[half:])}

    def store(batch: DataFrame, batch_id: int) -> None:
        files = sorted(r["path"] for r in batch.select("path").collect())  # at most files_per_batch
        start = _next_index(spark, target, batch_id)
        folder, bad = f"{target}/rows/{BATCH}={batch_id}", {}
        if files:
            try:
                write(files, folder, start)
            except Exception:
                bad = unreadable(files)
                if not bad:
                    raise
                good = [f for f in files if f not in bad]
                if good:
                    write(good, folder, start)
        counts: dict[str, int] = {}
        if len(bad) < len(files):
            counts = {r[SOURCE]: r["count"] for r in spark.read.parquet(folder).groupBy(SOURCE).count().collect()}  # one row per file
        by_name = {_plain(f): n for f, n in counts.items()}
        rows = [(batch_id, f, ERROR if f in bad else READY, bad.get(f, ""), 0 if f in bad else by_name.get(_plain(f), 0)) for f in files]
        spark.createDataFrame(rows, STATUS).coalesce(1).write.mode("overwrite").parquet(f"{target}/status/{BATCH}={batch_id}")
        offsets = [(batch_id, start, start + sum(counts.values()))]
        spark.createDataFrame(offsets, OFFSETS).coalesce(1).write.mode("overwrite").parquet(f"{target}/offsets/{BATCH}={batch_id}")

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _plain(path: str) -> str:
    """The path without its scheme, which the two lists of files spell in different ways."""
    return unquote(urlparse(path).path)


def _next_index(spark: SparkSession, target: str, batch_id: int) -> int:
    """Where the rows of a batch begin: what the batch before it has left, one small file."""
    if batch_id == 0:
        return 0
    return spark.read.schema(OFFSETS).parquet(f"{target}/offsets/{BATCH}={batch_id - 1}").first()["next_index"]


def ingest_status(spark: SparkSession, target: str) -> DataFrame:
    """``(batch_id, file, status, error_message, n_rows)`` of every file that was taken in or set aside."""
    return spark.read.schema(STATUS).parquet(f"{target}/status").select("batch_id", "file", "status", "error_message", "n_rows")


def ingested(spark: SparkSession, target: str) -> DataFrame:
    """The rows taken in so far, with their dense index."""
    return spark.read.parquet(f"{target}/rows").drop(BATCH, SOURCE)
