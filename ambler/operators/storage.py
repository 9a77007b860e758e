"""Where loops cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """The folder that the session shares, spark.checkpoint.dir; one of its own only where none is set
    and all tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix=name)


def checkpoint(df: DataFrame) -> DataFrame:
    """A copy in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession, "ambler-checkpoint-"))
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that nothing is at yet, in the shared folder."""
    return f"{shared_folder(spark, 'ambler-')}/ambler/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """A copy of many rows, as Parquet files in the folder of checkpoints: its last stage runs once, while
    that of a checkpoint runs twice, and the files are a fraction of the rows in memory."""
    found = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir()
    path = f"{found.get()}/rows-{uuid.uuid4().hex}" if found.isDefined() else new_folder(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
