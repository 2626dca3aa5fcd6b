"""Time spent in ordered events: worked time, stalls, segments, density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALL, MODEL_WAIT, TOOL_WAIT_MOST = 300_000, 1_800_000, 21_600_000
OTHER, USER, ASSISTANT, TOOL_RESULT, MODEL_STEP, TOOL_WAIT = range(6)


def record_kind(type_: Column, of_tool: Column) -> Column:
    """The kind of a record (OTHER to TOOL_WAIT) from its type and the tool whose call it answers, if any."""
    from weft.functions.errors import is_long_running

    result = F.when(of_tool.isNotNull() & is_long_running(of_tool), TOOL_WAIT).otherwise(TOOL_RESULT)
    return F.when(type_ == "user", USER).when(type_.isin("assistant", "call"), ASSISTANT).when(type_ == "reasoning", MODEL_STEP).when(type_ == "tool_result", result).otherwise(OTHER)


def gaps(events: DataFrame, key: str = "path") -> DataFrame:
    """``events`` (key, seq, ms, kind) with gap (from the latest time seen, null before one), and the kinds before.

    Records out of order measure no time twice. Untimed records have no gap, and their kind still counts as the
    previous event's, but not as the previous message's.
    """
    before = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    message = F.when(F.col("ms").isNotNull() & (F.col("kind") != OTHER), F.col("kind"))
    return events.withColumns({"gap": F.col("ms") - F.max("ms").over(before), "last_message": F.last(message, ignorenulls=True).over(before), "last_kind": F.last("kind").over(before)})


def counts_as_work(gap: Column, kind: Column, last_message: Column) -> Column:
    answered = (kind == ASSISTANT) & F.coalesce(last_message.isin(TOOL_RESULT, TOOL_WAIT), F.lit(False))
    return (gap > 0) & ((gap <= STALL) | ((kind == TOOL_WAIT) & (gap <= TOOL_WAIT_MOST)) | ((kind == MODEL_STEP) & (gap <= MODEL_WAIT)) | (answered & (gap <= MODEL_WAIT)))


def worked_time(events: DataFrame, key: str = "path") -> DataFrame:
    """(key, active_ms, at_message_ms): worked time in all and up to the last message."""
    g = gaps(events, key).withColumn("work", F.when(counts_as_work(F.col("gap"), F.col("kind"), F.col("last_message")), F.col("gap")).otherwise(0))
    upto = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("upto", F.sum("work").over(upto))
    return g.groupBy(key).agg(F.sum("work").alias("active_ms"), F.max(F.when((F.col("kind") != OTHER) & F.col("ms").isNotNull(), F.col("upto"))).alias("at_message_ms"))


def stalls(events: DataFrame, key: str = "path") -> DataFrame:
    """(key, stalls, stall_ms, longest_stall_ms, idle_ms): gaps of five minutes or more, by who waited."""
    g = gaps(events, key).filter(F.col("gap") >= STALL)
    waited = ((F.col("kind") == TOOL_WAIT) & (F.col("gap") <= TOOL_WAIT_MOST)) | ((F.col("kind") == ASSISTANT) & F.col("last_kind").isin(TOOL_RESULT, TOOL_WAIT) & (F.col("gap") <= MODEL_WAIT))
    waited = F.coalesce(waited, F.lit(False))
    return g.groupBy(key).agg(F.count_if(waited).alias("stalls"), F.sum(F.when(waited, F.col("gap")).otherwise(0)).alias("stall_ms"), F.coalesce(F.max(F.when(waited, F.col("gap"))), F.lit(0)).alias("longest_stall_ms"), F.sum(F.when(waited, 0).otherwise(F.col("gap"))).alias("idle_ms"))


def segments(events: DataFrame, key: str = "path", idle: int = 120_000) -> DataFrame:
    """(key, segment, start_ms, end_ms, n): runs of timed events without a gap of ``idle`` or more."""
    w = Window.partitionBy(key).orderBy("ms", "seq")
    cut = events.filter("ms is not null").withColumn("cut", (F.coalesce(F.col("ms") - F.lag("ms").over(w), F.lit(0)) >= idle).cast("int"))
    return cut.withColumn("segment", F.sum("cut").over(w)).groupBy(key, "segment").agg(F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"), F.count("*").alias("n"))


def activity_segments(events: DataFrame, key: str = "path", idle: int = 120_000, least: int = 3, least_ms: int = 10_000) -> DataFrame:
    """(key, start_ms, end_ms, active): a session's time line, active and idle stretches in turn.

    Idle are gaps of ``idle`` or more. A stretch of one instant is none. Sessions of fewer than ``least`` timed events or
    that last less than ``least_ms`` have no time line.
    """
    runs = segments(events, key, idle)
    spans = runs.groupBy(key).agg(F.sum("n").alias("all"), (F.max("end_ms") - F.min("start_ms")).alias("span")).filter((F.col("all") >= least) & (F.col("span") >= least_ms))
    runs = runs.join(spans.select(key), key, "left_semi")
    last = F.lag("end_ms").over(Window.partitionBy(key).orderBy("segment"))
    idle_ = runs.select(key, last.alias("start_ms"), F.col("start_ms").alias("end_ms"), F.lit(False).alias("active")).filter("start_ms is not null")
    return runs.filter("end_ms > start_ms").select(key, "start_ms", "end_ms", F.lit(True).alias("active")).unionByName(idle_)


def density(events: DataFrame, key: str = "path", buckets: int = 200) -> DataFrame:
    """(key, bucket, n): equal shares of a session's span, the last one closed; a session of one instant has one."""
    spans = events.filter("ms is not null").groupBy(key).agg(F.min("ms").alias("from_ms"), F.max("ms").alias("to_ms"))
    width = (F.col("to_ms") - F.col("from_ms")) / buckets
    at = F.when(width > 0, F.least(F.lit(buckets - 1), F.floor((F.col("ms") - F.col("from_ms")) / width))).otherwise(0).cast("int")
    return events.filter("ms is not null").join(spans, key).groupBy(key, at.alias("bucket")).agg(F.count("*").alias("n"))
