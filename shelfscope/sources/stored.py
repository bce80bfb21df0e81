"""Cutting the lineage of iterative jobs through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set to a temporary one where it is unset on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shelfscope-"))
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder and read from there."""
    _folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the session's checkpoint folder, read from there, for rounds that join what the
    last one left with itself: a checkpoint keeps the size that its plan was estimated to have, a product
    over joins, whose digits multiply with each round until they fill the driver. Files have a size."""
    spark = df.sparkSession
    where = f"{_folder(spark).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out.written_path = where
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes the files of tables that written() returned and that no later plan reads."""
    for df in tables:
        if where := getattr(df, "written_path", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(where)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
