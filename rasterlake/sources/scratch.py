"""Intermediate tables and files in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A new name below `spark.checkpoint.dir`; where that is unset and Spark runs in this machine alone, below a new local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _LOCAL.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` and reads it back, which cuts its lineage: a lost executor costs a reread of files."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
