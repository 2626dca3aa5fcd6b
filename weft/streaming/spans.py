"""Sessions followed as their recordings grow: worked time, and whether a session is at work, with timers.

State is that of ``transformWithState``: values and maps for each path, with timers and a time to live, kept by the
state store (set ``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider, see ``with_state``).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weft.functions.errors import is_long_running
from weft.functions.records import tool_name
from weft.operators import timing
from weft.streaming.live import IDLE_STOPS

BLOCKS = "array<struct<type:string,id:string,name:string,tool_use_id:string>>"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start within use the state store that ``transformWithState`` needs; the setting is then as before."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _call(id_: Column, name: Column) -> Column:
    return F.struct(id_.alias("id"), F.coalesce(is_long_running(tool_name(name)), F.lit(False)).alias("waits"))


def _millis(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text))


def records(lines: DataFrame, source: str) -> DataFrame:
    """``lines`` (line and others) with ms, kind, calls (id, waits: whether its tool keeps the agent waiting) and answers.

    The kinds are those of each source's lines; a result's kind is TOOL_RESULT until its calls are known, but where the
    line names the tool itself. Lines that aren't JSON have neither a time nor a kind. An fx recording stamps a turn's
    rows with the turn's end and has no such kinds: an unknown source is an error.
    """
    none_called, none_answered = F.lit(None).cast("array<struct<id:string,waits:boolean>>"), F.lit(None).cast("array<string>")
    kind = F.lit(timing.OTHER)
    if source in ("claude", "factory"):
        j = F.from_json("line", "type string, timestamp string, message struct<role:string,content:string>")
        rows = lines.withColumn("j", j).withColumn("b", F.when(F.ltrim("j.message.content").startswith("["), F.from_json("j.message.content", BLOCKS)))
        role = F.col("j.type") if source == "claude" else F.when(F.col("j.type") == "message", F.col("j.message.role"))
        answers = F.transform(F.filter("b", lambda x: x["type"] == "tool_result"), lambda x: x["tool_use_id"])
        calls = F.transform(F.filter("b", lambda x: (x["type"] == "tool_use") & x["id"].isNotNull()), lambda x: _call(x["id"], x["name"]))
        answered = F.coalesce(F.size(answers) > 0, F.lit(False))
        kind = F.when(role == "assistant", timing.ASSISTANT).when((role == "user") & answered, timing.TOOL_RESULT).when(role == "user", timing.USER).otherwise(kind)
        ms, calls, answers = _millis(F.col("j.timestamp")), F.when(role == "assistant", calls), F.when(role == "user", answers)
    elif source == "codex":
        rows = lines.withColumn("j", F.from_json("line", "timestamp string, type string, payload struct<type:string,role:string,name:string,call_id:string>"))
        p = F.when(F.col("j.type") == "response_item", F.col("j.payload"))
        result, call = p["type"].isin("function_call_output", "custom_tool_call_output"), p["type"].isin("function_call", "custom_tool_call")
        kind = F.when(p.isNull(), timing.OTHER).when(result, timing.TOOL_RESULT).when(call, timing.ASSISTANT).when(p["role"] == "user", timing.USER).when(p["role"].isin("developer", "system"), timing.OTHER).otherwise(timing.ASSISTANT)
        ms, calls, answers = _millis(F.col("j.timestamp")), F.when(call & p["call_id"].isNotNull(), F.array(_call(p["call_id"], p["name"]))), F.when(result, F.array(p["call_id"]))
    elif source in ("grok", "vktr"):
        rows = lines.withColumn("j", F.from_json("line", "type string, ts string, timestamp string, tool_name string"))
        waited = F.coalesce(is_long_running(tool_name(F.col("j.tool_name"))), F.lit(False))
        kind = F.when(F.col("j.type") == "turn_started", timing.USER).when(F.col("j.type") == "tool_completed", F.when(waited, timing.TOOL_WAIT).otherwise(timing.TOOL_RESULT)).when(F.col("j.type") == "first_token", timing.ASSISTANT).otherwise(kind)
        ms, calls, answers = _millis(F.coalesce(F.nullif("j.ts", F.lit("")), "j.timestamp")), none_called, none_answered
    elif source == "dsh":
        rows = lines.withColumn("j", F.from_json("line", "type string, time long, createdAt long, data struct<source:struct<kind:string>,message:struct<content:string,toolCallId:string,source:struct<callId:string>>>"))
        t, d = F.col("j.type"), F.col("j.data")
        parts = F.filter(F.from_json(d["message"]["content"], BLOCKS), lambda x: (x["type"] == "tool-call") & x["id"].isNotNull())
        kind = F.when((t == "user/message") & (d["source"]["kind"] == "user"), timing.USER).when(t == "assistant/message", timing.ASSISTANT).when(t == "tool/result", timing.TOOL_RESULT).otherwise(kind)
        ms = F.when(t == "session", F.col("j.createdAt")).otherwise(F.col("j.time"))
        calls, answers = F.when(t == "assistant/message", F.transform(parts, lambda x: _call(x["id"], x["name"]))), F.when(t == "tool/result", F.array(F.coalesce(d["message"]["toolCallId"], d["message"]["source"]["callId"])))
    else:
        raise ValueError(f"no record kinds for source: {source}")
    return rows.withColumns({"ms": ms, "kind": kind.cast("int"), "calls": F.coalesce(calls, none_called), "answers": F.coalesce(answers, none_answered)}).drop("j", "b")


def settled_kinds(rows: DataFrame, key: str = "path", order: str = "seq") -> DataFrame:
    """``rows`` of ``records`` with TOOL_WAIT for results of which any answers a call that keeps the agent waiting.

    A call counts for the results behind it, by its latest declaration. The exchange is by call, so a long session's
    calls are spread.
    """
    called = rows.select(key, F.col(order).alias("called_at"), F.explode("calls").alias("c")).select(key, "called_at", F.col("c.id").alias("id"), F.col("c.waits").alias("waits"))
    answered = rows.select(key, F.col(order).alias("answered_at"), F.explode("answers").alias("id"))
    latest = answered.join(called, [key, "id"]).filter("called_at < answered_at").groupBy(key, "answered_at", "id").agg(F.max_by("waits", "called_at").alias("waits"))
    waited = latest.filter("waits").select(key, F.col("answered_at").alias(order)).distinct().withColumn("waited", F.lit(True))
    return rows.join(waited, [key, order], "left").withColumn("kind", F.when(F.col("waited"), timing.TOOL_WAIT).otherwise(F.col("kind"))).drop("waited")


class WorkedTime(StatefulProcessor):
    """A path's span: latest time, kind of the last message, sums; and which open calls keep the agent waiting."""

    def __init__(self, forget_ms: int | None = None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.span = handle.getValueState("span", "generation int, latest long, last int, active long, at_message long, n long", self.forget_ms)
        self.waits = handle.getMapState("waits", "id string", "waits boolean", self.forget_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["generation", "start"])
        state = self.span.get() if self.span.exists() else (0, None, timing.OTHER, 0, None, 0)
        waits: dict[str, bool] = {}  # of this batch, before it goes to the store
        shown, half = state, False
        for r in zip(*(every[c].tolist() for c in ("generation", "ms", "kind", "calls", "answers", "whole"))):
            generation, ms, kind, calls, answers, whole = r
            if generation < state[0]:
                continue
            if generation > state[0]:
                state, waits = (generation, None, timing.OTHER, 0, None, 0), {}
                self.waits.clear()
            if kind == timing.TOOL_RESULT and any(self._waits(i, waits) for i in (answers if answers is not None else ())):
                kind = timing.TOOL_WAIT
            shown, half = self._add(state, ms, kind), not whole
            if whole:  # a half line counts on a copy alone, and comes again
                state = shown
                for c in calls if calls is not None else ():
                    waits[c["id"]] = c["waits"]
        self.span.update(state)
        for id_, wait in waits.items():
            if wait:
                self.waits.updateValue((id_,), (True,))
            elif self.waits.containsKey((id_,)):
                self.waits.removeKey((id_,))
        generation, _, _, active, at_message, n = shown
        yield pd.DataFrame({"path": [key[0]], "generation": [generation], "active_ms": [active], "at_message_ms": pd.array([at_message], "Int64"), "n": [n], "half": [half]})

    def _waits(self, id_, waits: dict[str, bool]) -> bool:
        return id_ is not None and (waits[id_] if id_ in waits else self.waits.containsKey((id_,)))

    @staticmethod
    def _add(state: tuple, ms, kind: int) -> tuple:
        generation, latest, last, active, at_message, n = state
        if ms is None or pd.isna(ms):
            return generation, latest, last, active, at_message, n + 1
        gap = 0 if latest is None else int(ms) - latest
        answered = kind == timing.ASSISTANT and last in (timing.TOOL_RESULT, timing.TOOL_WAIT)
        most = timing.TOOL_WAIT_MOST if kind == timing.TOOL_WAIT else timing.MODEL_WAIT if answered or kind == timing.MODEL_STEP else timing.STALL
        active += gap if 0 < gap <= most else 0
        latest = int(ms) if latest is None else max(latest, int(ms))
        return generation, latest, last if kind == timing.OTHER else kind, active, at_message if kind == timing.OTHER else active, n + 1


def growing_worked_time(lines: DataFrame, source: str, forget_ms: int | None = None) -> DataFrame:
    """(path, generation, active_ms, at_message_ms, n, half) of recordings as their lines arrive from the growing source.

    Only new lines are read; a line that isn't finished counts in what is shown and not in the state (``half``). A path
    that nothing is written to for ``forget_ms`` leaves the state; if it grows afterwards, it counts from there.
    """
    rows = records(lines, source).select("path", "generation", "start", "ms", "kind", "calls", "answers", "whole")
    out = "path string, generation int, active_ms long, at_message_ms long, n long, half boolean"
    return rows.groupBy("path").transformWithStateInPandas(WorkedTime(forget_ms), out, "Update", "ProcessingTime" if forget_ms else "None")


class Generating(StatefulProcessor):
    """Open calls and the last turn of a path; a timer ends the turn of a silent session, a later one forgets it."""

    def __init__(self, idle_ms: int, forget_ms: int):
        self.idle_ms, self.forget_ms = idle_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "last string, stop string, latest long, n long")
        self.open = handle.getMapState("open", "id string", "open boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, stop, latest, n = self.turn.get() if self.turn.exists() else ("", "", None, 0)
        every = pd.concat(list(rows)).sort_values("seq")
        known = {k[0] for k in self.open.keys()}
        open_ = set(known)
        for type_, id_, stopped, interrupted, ms in zip(*(every[c].tolist() for c in ("type", "tool_use_id", "stop", "interrupted", "ms"))):
            n, latest = n + 1, int(ms) if latest is None else max(latest, int(ms))
            if interrupted:
                open_, last = set(), "interrupted"
            elif type_ == "call":
                last, stop = "assistant", "tool_use"
                open_ |= {id_} - {None}
            elif type_ == "assistant":
                last, stop = "assistant", stopped or ""
            elif type_ == "tool_result":
                open_.discard(id_)
                last = "user"
            elif type_ == "user":
                last = "user"
        for id_ in open_ - known:
            self.open.updateValue((id_,), (True,))
        for id_ in known - open_:
            self.open.removeKey((id_,))
        self.turn.update((last, stop, latest, n))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(latest + self.idle_ms)
        self.handle.registerTimer(latest + self.forget_ms)
        works = bool(open_) or last == "user" or last == "assistant" and stop not in IDLE_STOPS
        yield self._row(key, works, len(open_), n, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.turn.exists():
            return
        _, _, latest, n = self.turn.get()
        if expiredTimerInfo.getExpiryTimeInMs() >= latest + self.forget_ms:
            self.turn.clear()
            self.open.clear()
            return
        yield self._row(key, False, len(list(self.open.keys())), n, True)

    @staticmethod
    def _row(key, generating: bool, pending: int, n: int, silent: bool) -> pd.DataFrame:
        return pd.DataFrame({"path": [key[0]], "generating": [generating], "pending": pd.array([pending], "Int32"), "n": [n], "silent": [silent]})


def timed_generating(events: DataFrame, idle_ms: int = 300_000, forget_ms: int = 86_400_000, late: str = "0 seconds") -> DataFrame:
    """(path, generating, pending, n, silent) as events (path, seq, ts, type, tool_use_id, stop, interrupted) arrive.

    As ``live.generating``; besides, a session without events for ``idle_ms`` of event time is no longer at work
    (``silent``), without an event of its own, and after ``forget_ms`` its state is gone. Events more than ``late`` behind
    the latest ones of earlier batches are dropped.
    """
    rows = events.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    kind = events.schema["path"].dataType.simpleString()
    return rows.groupBy("path").transformWithStateInPandas(Generating(idle_ms, forget_ms), f"path {kind}, generating boolean, pending int, n long, silent boolean", "Update", "EventTime")


def sliding_counts(events: DataFrame, key: str, size: str = "1 hour", every: str = "15 minutes", late: str = "0 seconds") -> DataFrame:
    """(start, key, n): events of overlapping windows; a window leaves the state when the watermark has passed it."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, every), key).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), key, "n")


def session_windows(events: DataFrame, key: str, gap: str = "5 minutes", late: str = "0 seconds") -> DataFrame:
    """(key, start, stop, n): runs of events less than ``gap`` apart, once they are closed (append mode); ``stop`` is the
    last event's time plus ``gap``."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return w.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def answered_calls(calls: DataFrame, results: DataFrame, keys: list[str], within: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """Calls (keys, ts, ...) beside their results (keys, ts, ...) no later than ``within``, as both arrive; the columns of
    results besides keys begin with ``result_``. State of both sides goes as the watermark passes."""
    left = calls.withWatermark("ts", late).alias("c")
    right = results.select(*(F.col(c).alias(f"result_{c}") for c in results.columns)).withWatermark("result_ts", late)
    same = reduce(lambda a, b: a & b, (F.col(f"c.{k}") == F.col(f"result_{k}") for k in keys))
    timed = (F.col("result_ts") >= F.col("c.ts")) & (F.col("result_ts") <= F.col("c.ts") + F.expr(f"interval {within}"))
    return left.join(right, same & timed).drop(*(f"result_{k}" for k in keys))
