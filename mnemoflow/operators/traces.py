"""Traces: spans out of the starts, completions, errors and skips of stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import round_to

def pair_spans(events: DataFrame) -> DataFrame:
    """(trace_id, stage, start_id, end_id, state, duration_ms, parent_id) of events(trace_id, event_id, ts, stage, status, parent_stage).

    A completion or error ends the last start of its stage, if nothing has ended that: complete or error. One that finds none is an orphan; a
    start that another start of the stage follows first is replaced, the last one without an end is open; a skip is a span of its own.
    parent_id is the start of the parent stage that is open where the span begins, null where none is. Events of a trace and stage are
    ordered by time, then id; both windows are keyed by trace and stage.
    """
    marks = events.where(F.col("status").isin("start", "complete", "error"))
    order = Window.partitionBy("trace_id", "stage").orderBy("ts", "event_id")
    own = marks.withColumn("before", F.lag(F.struct("status", "event_id", "ts")).over(order)).withColumn("after", F.lead("status").over(order))
    ended, begun = F.col("status") != "start", F.coalesce(F.col("before.status") == "start", F.lit(False))
    state = F.when(ended & begun, F.col("status")).when(ended, "orphan").when(F.col("after").isNull(), "open").when(F.col("after") == "start", "replaced")
    ms = round_to((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("before.ts").cast("timestamp"))) / 1000, 2)
    spans = own.withColumn("state", state).where("state is not null").select(
        "trace_id", "stage", "parent_stage", F.when(ended & begun, F.col("before.event_id")).when(~ended, F.col("event_id")).alias("start_id"), F.when(ended, F.col("event_id")).alias("end_id"), "state",
        F.when(ended & begun, ms).alias("duration_ms"), F.when(ended & begun, F.col("before.ts")).otherwise(F.col("ts")).alias("from_ts"),
    )
    skipped = events.where("status = 'skipped'").select("trace_id", "stage", "parent_stage", F.lit(None).cast("long").alias("start_id"), F.col("event_id").alias("end_id"), F.lit("skipped").alias("state"), F.lit(None).cast("double").alias("duration_ms"), F.col("ts").alias("from_ts"))
    spans = spans.union(skipped).withColumn("at", F.coalesce("start_id", "end_id"))

    # What is open in each stage, as it changes, and the spans that ask for it, in one order.
    opened = marks.select("trace_id", F.col("stage").alias("key"), F.col("ts").alias("when"), F.col("event_id").alias("by"), F.lit(1).alias("turn"), F.struct(F.when(F.col("status") == "start", F.col("event_id")).alias("id")).alias("open"), F.lit(None).cast(spans.select(F.struct(*spans.columns).alias("s")).schema["s"].dataType).alias("span"))
    asking = spans.select("trace_id", F.col("parent_stage").alias("key"), F.col("from_ts").alias("when"), F.col("at").alias("by"), F.lit(0).alias("turn"), F.lit(None).cast("struct<id:bigint>").alias("open"), F.struct(*spans.columns).alias("span"))
    latest = F.last("open", ignorenulls=True).over(Window.partitionBy("trace_id", "key").orderBy("when", "by", "turn").rowsBetween(Window.unboundedPreceding, -1))
    return opened.union(asking).withColumn("parent", latest).where("span is not null").select("span.trace_id", "span.stage", "span.start_id", "span.end_id", "span.state", "span.duration_ms", F.when(F.col("span.parent_stage").isNotNull(), F.col("parent.id")).alias("parent_id"))
