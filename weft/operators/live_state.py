"""Whether a session is at work, told from the last lines of its recording, by the rules of its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.streaming.live import IDLE_STOPS

BLOCKS = "array<struct<type:string,text:string,id:string,tool_use_id:string>>"
# Phases in which one source's model or tools are busy, how an interruption begins, kinds of lines that
# begin and end a turn, calls and their outputs.
LIVE_PHASE = r"^(?:waiting_for_model|streaming_|tool_execution|permission_prompt)"
INTERRUPTED = "[Request interrupted by user"
ENDED = ("task_complete", "task_completed", "turn_aborted")
CALLED, ANSWERED = ("custom_tool_call", "function_call", "web_search_call"), ("custom_tool_call_output", "function_call_output")
DONE = ("completed", "success")


def _clamped(rows: DataFrame, step: Column, name: str) -> DataFrame:
    """``rows`` with ``name`` so far: the running sum of ``step`` that never falls below zero.

    It is the plain sum less the lowest it has been (at most zero)."""
    upto = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sum_", F.sum(step).over(upto))
    return rows.withColumn(name, F.col("sum_") - F.least(F.lit(0), F.min("sum_").over(upto))).drop("sum_")


def _last(value: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.col("seq")))


def _messages(lines: DataFrame, source: str) -> DataFrame:
    """path, seq, role, stop, asked and answered ids, clears (a result without an id), interrupted, mid_write."""
    j = F.from_json("line", "type string, subtype string, role string, stop_reason string, message struct<role:string,content:string,stop_reason:string>")
    rows = lines.withColumn("j", j).withColumn("b", F.when(F.ltrim("j.message.content").startswith("["), F.from_json("j.message.content", BLOCKS)))
    if source == "claude":
        role = F.when(F.col("j.type").isin("assistant", "user"), F.col("j.type"))
    else:
        role = F.when(F.coalesce("j.type", F.lit("message")) == "message", F.coalesce("j.message.role", "j.role"))
    results, uses = F.filter("b", lambda x: x["type"] == "tool_result"), F.filter("b", lambda x: x["type"] == "tool_use")
    said = F.when(F.col("b").isNull(), F.col("j.message.content").startswith(INTERRUPTED)).otherwise(F.exists("b", lambda x: (x["type"] == "text") & x["text"].startswith(INTERRUPTED)))
    none = F.array().cast("array<string>")
    return rows.select(
        "path", "seq", "mid_write", role.alias("role"), F.coalesce("j.message.stop_reason", "j.stop_reason").alias("stop"), F.coalesce(F.when(role == "assistant", F.transform(uses, lambda x: F.coalesce(x["id"], F.lit("")))), none).alias("asked"),
        F.coalesce(F.when(role == "user", F.transform(F.filter(results, lambda x: x["tool_use_id"].isNotNull()), lambda x: x["tool_use_id"])), none).alias("answered"), F.coalesce((role == "user") & F.exists(results, lambda x: x["tool_use_id"].isNull()), F.lit(False)).alias("clears"),
        F.coalesce((F.lit(source == "claude")) & (role == "user") & said, F.lit(False)).alias("interrupted"), F.coalesce((F.lit(source == "claude")) & F.col("j.subtype").isin("away_summary", "turn_duration"), F.lit(False)).alias("closing"), (F.coalesce(F.size(results), F.lit(0)) > 0).alias("results"),
    )


def _of_messages(lines: DataFrame, source: str) -> DataFrame:
    m = _messages(lines, source)
    cleared = m.groupBy("path").agg(F.max(F.when(F.col("clears") | F.col("interrupted"), F.col("seq"))).alias("cleared"))
    asked = m.select("path", "seq", F.explode("asked").alias("id")).groupBy("path", "id").agg(F.max("seq").alias("asked_at"))
    answered = m.select("path", "seq", F.explode("answered").alias("id")).groupBy("path", "id").agg(F.max("seq").alias("answered_at"))
    open_ = asked.join(answered, ["path", "id"], "left").join(cleared, "path").filter("(answered_at is null or answered_at < asked_at) and (cleared is null or cleared < asked_at)")
    pending = open_.groupBy("path").agg(F.count("*").alias("pending"))
    assistant = F.col("role") == "assistant"
    stop = F.when(assistant, F.coalesce(F.nullif("stop", F.lit("")), F.when(F.size("asked") > 0, "tool_use"), F.lit("")))
    state = m.groupBy("path").agg(
        _last(F.when(F.col("interrupted"), "interrupted").otherwise(F.col("role"))).alias("role"), _last(stop).alias("stop"), F.max(F.when(assistant, F.col("seq"))).alias("turn"), F.max(F.when(F.col("closing"), F.col("seq"))).alias("closed"),
        _last(F.when(assistant, F.size("asked") > 0).when((F.col("role") == "user") & F.col("results"), False)).alias("unmatched"), F.max("mid_write").alias("mid_write"),
    )
    both = state.join(pending, "path", "left").fillna(0, ["pending"])
    if source == "claude":  # a note behind a turn that named no stop ends it
        stop = F.when((F.col("stop") == "") & (F.col("closed") > F.col("turn")), "end_turn").otherwise(F.col("stop"))
        works = (F.col("role") == "user") | ((F.col("role") == "assistant") & ~stop.isin(*IDLE_STOPS))
    else:
        works = F.col("unmatched") | (F.col("role") == "user")
    return both.select("path", (F.col("mid_write") | (F.col("pending") > 0) | F.coalesce(works, F.lit(False))).alias("generating"), F.col("pending").cast("long").alias("pending"))


def _of_turns(rows: DataFrame, task: Column, tool: Column, boundary: Column, phase: Column) -> DataFrame:
    """Open tasks and tools (counters that don't fall below zero), the last boundary, and whether the last of boundaries and
    phases is a busy phase. Without a boundary the turn began before the tail."""
    counted = _clamped(_clamped(rows.withColumns({"task": task, "tool": tool, "boundary": boundary, "phase": phase}), F.col("task"), "tasks"), F.col("tool"), "tools")
    busy = F.when(F.col("boundary").isNotNull(), False).otherwise(F.col("phase"))
    state = counted.groupBy("path").agg(F.max_by("tasks", "seq").alias("tasks"), F.max_by("tools", "seq").alias("pending"), _last(F.col("boundary")).alias("boundary"), _last(busy).alias("busy"), F.max("mid_write").alias("mid_write"))
    works = F.col("mid_write") | (F.col("tasks") > 0) | (F.col("pending") > 0) | F.coalesce("busy", F.lit(False)) | (F.coalesce("boundary", F.lit("none")) != "ended")
    return state.select("path", works.alias("generating"), F.col("pending").cast("long").alias("pending"))


def generating(lines: DataFrame, source: str) -> DataFrame:
    """(path, generating, pending) from the last lines (path, seq, line, mid_write) of recordings of one source.

    ``grok`` lines are those of its events. Lines that aren't JSON say nothing; a session without lines has no row.
    """
    if source in ("claude", "factory"):
        return _of_messages(lines, source)
    if source == "cursor":  # at work from a turn until one is said to have ended
        j = F.from_json("line", "type string, role string")
        turn = j["role"].isin("assistant", "user") | F.coalesce(j["type"].isin("assistant", "user"), F.lit(False))
        rows = lines.withColumn("works", F.when(j["type"] == "turn_ended", False).when(turn, True))
        return rows.groupBy("path").agg((F.max("mid_write") | F.coalesce(_last(F.col("works")), F.lit(False))).alias("generating"), F.lit(0).cast("long").alias("pending"))
    if source == "codex":
        rows = lines.withColumn("j", F.from_json("line", "type string, payload struct<type:string,status:string>")).filter("j.type is not null")
        event, item = F.when(F.col("j.type") == "event_msg", F.col("j.payload.type")), F.when(F.col("j.type") == "response_item", F.col("j.payload.type"))
        open_ = item.isin(*CALLED) & ~F.coalesce(F.col("j.payload.status").isin(*DONE), F.lit(False))
        step = lambda up, down: F.when(F.coalesce(up, F.lit(False)), 1).when(F.coalesce(down, F.lit(False)), -1).otherwise(0)
        boundary = F.when(event == "task_started", "started").when(event.isin(*ENDED), "ended")
        return _of_turns(rows, step(event == "task_started", event.isin(*ENDED)), step(open_, item.isin(*ANSWERED)), boundary, F.lit(None).cast("boolean"))
    if source in ("grok", "vktr"):
        rows = lines.withColumn("j", F.from_json("line", "type string, phase string")).filter("j.type is not null")
        kind = F.col("j.type")
        boundary = F.when(kind == "turn_started", "started").when(kind == "turn_ended", "ended")
        phase = F.when((kind == "phase_changed") & (F.coalesce("j.phase", F.lit("")) != ""), F.col("j.phase").rlike(LIVE_PHASE))
        return _of_turns(rows, F.lit(0), F.when(kind == "tool_started", 1).when(kind == "tool_completed", -1).otherwise(0), boundary, phase)
    raise ValueError(f"no live state of source: {source}")
