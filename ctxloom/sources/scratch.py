"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where it is unset and everything runs in this process."""
    at = spark.conf.get("spark.checkpoint.dir", "")
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(spark, "_ctxloom_scratch", None) or "file://" + tempfile.mkdtemp(prefix="ctxloom-")
        spark._ctxloom_scratch = at
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ctxloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table of its own: cuts lineage, and lost executors cost no earlier step."""
    at = new_path(df.sparkSession, name)
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._ctxloom_at = at
    return out


def drop(*frames: DataFrame) -> None:
    """Delete what written() wrote, once nothing reads it any more."""
    for df in frames:
        at = getattr(df, "_ctxloom_at", None)
        if at:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
