"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, in one process alone, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or _own_dir()).rstrip("/")


@cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='mnemoflow-')}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: it is worked out once, and its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/mnemoflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
