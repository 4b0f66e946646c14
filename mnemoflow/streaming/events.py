"""Streams of events: sessions as mergeable intervals, and a rate limiter.

Sources are file streams over a folder of Parquet; sinks are Parquet with a checkpoint in the shared folder. No state of a key is
held between micro-batches, so that late events and the order of files do not matter.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SESSION = "user_id long, started_us long, last_us long, n long"


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events", files_per_trigger: int = 8) -> DataFrame:
    """The files of a table as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{table}.parquet*")


def session_parts(events: DataFrame, timeout_s: int = 1800) -> DataFrame:
    """Mergeable intervals (user_id, started_us, last_us, n): runs of a user's events within an Arrow batch, with gaps under the
    timeout. They need no order of files or micro-batches and no shuffle, so that a user of any size costs no task more."""
    timeout = timeout_s * 1_000_000

    def run(batches):
        for batch in batches:
            user, us = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            order = np.lexsort((us, user))
            user, us = user[order], us[order]
            first = np.flatnonzero(np.r_[np.ones(min(1, len(us)), bool), (user[1:] != user[:-1]) | (us[1:] - us[:-1] >= timeout)])
            ends = np.r_[first[1:], len(us)][: len(first)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (user[first], us[first], us[ends - 1], ends - first)], ["user_id", "started_us", "last_us", "n"])

    keyed = events.where("user_id is not null and ts is not null").select(F.col("user_id").cast("long").alias("user_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return keyed.mapInArrow(run, SESSION)


def merged_sessions(parts: DataFrame, timeout_s: int = 1800) -> DataFrame:
    """Sessions of the intervals of session_parts, with the mark whether each has ended: whether the newest event of all lies the
    timeout or more after its last one."""
    timeout = timeout_s * 1_000_000
    each = Window.partitionBy("user_id").orderBy("started_us", "last_us")
    reached = F.max("last_us").over(each.rowsBetween(Window.unboundedPreceding, -1))
    number = F.sum(F.coalesce((F.col("started_us") - F.col("reached") >= timeout).cast("long"), F.lit(0))).over(each.rowsBetween(Window.unboundedPreceding, 0))
    own = parts.withColumn("reached", reached).withColumn("session", number).groupBy("user_id", "session").agg(F.min("started_us").alias("started_us"), F.max("last_us").alias("last_us"), F.sum("n").alias("n"))
    newest = F.broadcast(parts.agg(F.max("last_us").alias("newest")))
    return own.join(newest).select("user_id", "started_us", "last_us", "n", (F.col("newest") - F.col("last_us") >= timeout).alias("ended"))


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Reads what the source has now, and returns what was written."""
    spark = stream.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = (named or f"file://{tempfile.mkdtemp(prefix='mnemoflow-')}").rstrip("/")
    path = f"{base}/mnemoflow/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/rows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def rate_limit(requests: DataFrame, most: int = 10, window_s: int = 60) -> DataFrame:
    """(event_id, key, allowed, remaining) of requests(event_id, key, ts): fixed windows that begin with a key's first request.

    Rejected requests count too. Keys are dealt by hash and sorted within tasks; the fold keeps three numbers, so that a
    key of any size passes in constant memory.
    """
    size = window_s * 1_000_000

    def run(batches):
        key, reset, count = None, 0, 0
        for batch in batches:
            out: list[tuple[bool, int]] = []
            for k, us in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != key or us >= reset:
                    key, reset, count = k, us + size, 0
                count += 1
                out.append((count <= most, max(0, most - count)))
            allowed, left = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(allowed, pa.bool_()), pa.array(left, pa.int64())], ["event_id", "key", "allowed", "remaining"])

    own = requests.where("key is not null and ts is not null").select(F.col("event_id").cast("long").alias("event_id"), F.col("key").cast("long").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return own.repartition("key").sortWithinPartitions("key", "us", "event_id").mapInArrow(run, "event_id long, key long, allowed boolean, remaining long")
