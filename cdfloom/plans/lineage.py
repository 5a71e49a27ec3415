"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigParseError


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; one of its own for a single machine that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ConfigParseError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """`df` computed now and kept in the shared folder: a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
