"""Message windows, sessions, jobs, clocks and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(messages: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return messages.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")


def turn_pairs(messages: DataFrame) -> DataFrame:
    """Each assistant turn with the last user turn before it."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    user = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(before)
    return messages.withColumn("user_turn", user).where("role = 'assistant'").select("conv_id", "turn", "user_turn")


def prior_context(messages: DataFrame, most: int = 6) -> DataFrame:
    """The last `most` messages before the previous turn, as `[role]: text` joined by blank lines."""
    # At most most + 1 rows end with the previous one, of which those before turn - 1 count.
    line = F.struct("turn", F.concat(F.lit("["), F.col("role"), F.lit("]: "), F.col("text")).alias("line"))
    near = F.collect_list(line).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-(most + 1), -1))
    kept = F.slice(F.reverse(F.filter(near, lambda s: s["turn"] < F.col("turn") - 1)), 1, most)
    return messages.select("conv_id", "turn", F.array_join(F.transform(F.reverse(kept), lambda s: s["line"]), "\n\n").alias("context"))


def sessions(events: DataFrame, timeout_s: int = 1800, ttl_s: int | None = None) -> DataFrame:
    """(user_id, session, started_at, last_at, n, expired): a gap of at least the timeout ends a session."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(order)
    marked = events.select("user_id", "event_id", "ts", F.when(gap >= timeout_s * 1_000_000, 1).otherwise(0).alias("cut"))
    numbered = marked.withColumn("session", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy("user_id", "session").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_at"), F.count("*").alias("n"))
    return out if ttl_s is None else out.withColumn("expired", F.unix_micros("last_at") - F.unix_micros("started_at") >= ttl_s * 1_000_000)


def event_clock(events: DataFrame) -> DataFrame:
    """Running counter per user: 1 for a turn (purchase or signup), 0.3 for a retrieval (view)."""
    step = F.when(F.col("event_type").isin("purchase", "signup"), 1.0).when(F.col("event_type") == "view", 0.3).otherwise(0.0)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("event_id", "user_id", F.round(F.sum(step).over(order), 4).alias("clock"))
