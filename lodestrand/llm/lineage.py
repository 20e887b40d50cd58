"""Cutting lineage through files that every executor can read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..lineage import folder, new_folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back: a lost executor costs no recomputation."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``cut``, as a Parquet table in the checkpoint folder: a fraction of a checkpoint's size for rows of numbers.

    Spark removes the write's shuffle files when it ends: nothing else reads them."""
    spark = df.sparkSession
    path, setting = new_folder(spark, "table"), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    return spark.read.parquet(path)
