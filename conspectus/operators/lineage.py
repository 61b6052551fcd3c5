"""Cutting lineage between the rounds of a loop, and folders that all executors reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Where none is named a local session gets a temporary one; any other has to name one.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="conspectus-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


def folder(spark: SparkSession) -> str:
    """A new folder's path below the shared one."""
    return f"{shared(spark).rstrip('/')}/conspectus-{uuid.uuid4().hex}"
