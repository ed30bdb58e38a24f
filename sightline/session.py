"""Session settings the library relies on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def builder(app: str = "sightline") -> SparkSession.Builder:
    """A builder with the settings every plan assumes (UTC, AQE, skew joins)."""
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # call sites of every column expression: costs seconds on long plans
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder lineage is cut into: the cluster's own.

    Where none is set, a temporary one if driver and executors are one process; on a
    cluster they would not see each other's files, so that raises.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    target = shared or tempfile.mkdtemp(prefix="sightline-checkpoint-")
    spark.sparkContext.setCheckpointDir(target)
    return target


def staged(df: DataFrame) -> DataFrame:
    """Write a table that several branches of a plan read, and read it back.

    It lives in the checkpoint folder, so a lost executor costs a re-read and not a
    re-computation; as Parquet it stays prunable and its size is known to the
    optimizer.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_utc(wall_clock: Column) -> Column:
    """A timestamp without zone, read as UTC whatever the session's zone is."""
    return F.from_utc_timestamp(wall_clock.cast("timestamp"), F.current_timezone())
