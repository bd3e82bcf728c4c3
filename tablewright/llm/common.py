"""What the operators share: reading tables, appending columns batch by batch, clashing names."""

from __future__ import annotations

import os
import tempfile
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from tablewright.functions.parsing import column
from tablewright.llm.words import slices


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors once in a session, since tasks import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="tablewright-"), "tablewright.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(archive)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` with this package at hand."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def others(df: DataFrame, added: list[str]) -> list[Column]:
    """The columns of ``df`` but those whose name an operator is about to add."""
    names = {n.lower() for n in added}
    return [column(c) for c in df.columns if c.lower() not in names]


def as_struct(schema: str) -> StructType:
    return _parse_datatype_string(schema)


def append_columns(df: DataFrame, read: list[str], schema: str, fn: Callable[..., list[pa.Array]], by: str | None = None) -> DataFrame:
    """The rows of ``df`` with the columns of ``schema``, which ``fn`` makes from the columns ``read``.

    ``fn`` gets slices of the columns ``read`` as Arrow arrays, cut so that the first of them (or the one
    named by ``by``), which holds texts, has about a MB in a slice. Columns are passed by position, so an input column may have any
    name; one whose name is in ``schema`` gives way to the new column.
    """
    added = as_struct(schema)
    at = [df.columns.index(c) for c in read]
    cut = df.columns.index(by or read[0])
    names = {f.name.lower() for f in added}
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in names]
    fields = [StructField(f"_{k}", df.schema[i].dataType) for k, i in enumerate(kept)]
    made = [StructField(f"_{len(kept) + k}", f.dataType) for k, f in enumerate(added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(cut)):
                part = batch.slice(a, b - a)
                arrays = [part.column(i) for i in kept] + fn(*[part.column(i) for i in at])
                yield pa.RecordBatch.from_arrays(arrays, [f"_{k}" for k in range(len(arrays))])
                del part, arrays
            del batch  # else it would lie beside the next one while that is read
            pa.default_memory_pool().release_unused()

    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    out = map_arrow(plain, run, StructType([*fields, *made]))
    titles = [df.columns[i] for i in kept] + [f.name for f in added]
    return out.select(*[F.col(f"_{k}").alias(title) for k, title in enumerate(titles)])


#: Numbers of a summed array that travel in one row.
_CHUNK = 8192
_SALTS = 16


def summed_arrays(df: DataFrame, size: int, add: Callable[..., None], by_bytes: int = 1 << 20) -> np.ndarray:
    """The sum over all rows of an array of ``size`` counts, which has a fixed size however many rows there are.

    ``add(total, *columns)`` adds the counts of a slice of rows to the task's own array; the first column holds texts
    and decides how slices are cut. Tasks hand on their arrays in compressed chunks, which are added as they stream in, in
    two steps, so no task and no group holds more than a few arrays.
    """

    def emit(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.astype("<i8").tobytes(), 1)], pa.binary())], ["chunk", "sums"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for a, b in slices(batch.column(0), by_bytes):
                part = batch.slice(a, b - a)
                add(total, *part.columns)
        yield from emit({k: total[at : at + _CHUNK] for k, at in enumerate(range(0, size, _CHUNK)) if total[at : at + _CHUNK].any()})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(raw), "<i8")
        yield from emit(sums)

    schema = "chunk int, sums binary"
    parts = map_arrow(df, count, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(_SALTS)))
    once = map_arrow(parts.repartition("chunk", "salt").select("chunk", "sums"), merge, schema)
    out = np.zeros(size, np.int64)
    for row in map_arrow(once.repartition("chunk"), merge, schema).collect():  # size / _CHUNK rows
        part = np.frombuffer(zlib.decompress(row["sums"]), "<i8")
        out[row["chunk"] * _CHUNK : row["chunk"] * _CHUNK + len(part)] = part
    return out
