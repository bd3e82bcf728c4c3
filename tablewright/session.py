"""Session helpers: a local test session and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType


def local_session(cores: str = "*", app: str = "tablewright", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster use the session that is handed in."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only for local runs that set none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="tablewright-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Computes a small intermediate table once and goes on from its checkpoint."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


# Rows of a written side up to which a join is told to broadcast it: keys and a few numbers each,
# so some tens of MB. Larger sides are left to Spark.
BROADCAST_ROWS = 200_000


def broadcast_if_small(written: DataFrame) -> DataFrame:
    """Marks a table that is already written for broadcast, if counting shows that it is small.

    Spark's own estimate of such a table goes back to the data it was made from, so without the mark
    it would shuffle the other, large side.
    """
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def scratch_path(spark: SparkSession) -> str:
    """A new path below the shared folder."""
    return f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` once as a Parquet table in the shared folder and goes on from the written copy.

    Needed where later steps must see exactly the rows and partition numbers of an earlier one
    (range boundaries are sampled, so a recomputed stage could place rows differently). Later steps
    read only the columns they use, and a lost executor only means reading files again. The table
    lives beside the session's checkpoints and goes when that folder is cleared.
    """
    if any(isinstance(f.dataType, NullType) for f in df.schema.fields):  # Parquet has no untyped column
        return cut(df)
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
