"""Intermediate tables that several later steps read, in files that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: the one that is set, else spark.checkpoint.dir, else - in local mode, as in tests - a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestrand-kept-"))
    return context.getCheckpointDir()


#: Folders that this process wrote and ``release`` may remove.
MADE: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the checkpoint folder, for the driver and all executors."""
    MADE.append(f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def release(spark: SparkSession) -> int:
    """Removes the tables that this process has written between its steps, for long sessions; frames that still read them can't be used any more."""
    n = len(MADE)
    while MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the checkpoint folder, as a Parquet table: a fraction of a checkpoint's size, and read by column."""
    path = new_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
