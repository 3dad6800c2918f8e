"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, below a temporary folder on one machine, an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tracewell-')}")
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once and read back: what several branches of a plan read isn't computed in each, and a lost executor costs a re-read."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(df: DataFrame, rows: int) -> int:
    """How many tasks get at most about ``rows`` of the rows each. Counts them, so for tables only."""
    return max(1, -(-df.count() // rows))


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """The rows, dealt out to a task for each ``rows`` of them: a file of few bytes can hold many, and one task would read them all."""
    n = tasks(df, rows)
    return df if n == 1 else df.repartition(n, *by)
