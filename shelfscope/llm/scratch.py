"""Written intermediate tables, in the folder that all executors share.

The folder is the session's `spark.checkpoint.dir`. Where that is unset, a temporary folder serves a
session whose executors share the driver's machine; on a cluster an error is raised, for what one
executor writes to its own disk no other can read. Each call has a folder of its own, so that runs
never meet; drop() removes what is no longer needed.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that go to a Python worker at once, about; a longer text goes alone.
BATCH_BYTES = 4 << 20
_local: list[str] = []


def path(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="shelfscope-"))
        base = _local[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's bound on Arrow batches, so that a task holds few texts at a time."""
    spark.conf.set(_ARROW, str(BATCH_BYTES))


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside go as soon as each has written its result."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet and reads it back: a lost executor costs no earlier stage anew."""
    spark = df.sparkSession
    where = path(spark, name)
    with freed_shuffles(spark):
        df.write.parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out.scratch_path = where
    return out


def remove(spark: SparkSession, where: str) -> None:
    """Deletes a folder, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(where)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Removes the files of tables that save() returned and that no later plan reads."""
    for df in tables:
        if where := getattr(df, "scratch_path", None):
            remove(df.sparkSession, where)
