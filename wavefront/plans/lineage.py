"""Keeping what loops have computed, on storage that outlives executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> None:
    """Checkpoints go where ``spark.checkpoint.dir`` says.

    Where it is unset a temporary folder is taken, but only in a local session:
    executors on other machines would not see it.
    """
    if spark.sparkContext.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="wavefront-"))


def durable(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
