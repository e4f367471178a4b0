"""The folder that driver and executors share, and cutting lineage between stages of a long plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a session in one process has a folder of its own, and any other raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
    return _own[context.applicationId]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new name below the shared folder."""
    return f"{shared_root(spark)}/rasterloom-{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df as rows in the checkpoint folder, which outlive executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()
