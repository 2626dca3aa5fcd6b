"""Streams with state: recordings that grow between runs, timers, sliding and session windows, joined streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import live_state, timing
from weft.plans.analysis import STEPS_SQL
from weft.plans.base import EVENTS_SQL, SQL, query, read, shared_folder, timed_events
from weft.plans.recordings import write_files
from weft.plans.streams import GENERATING, _Streamed
from weft.sources import ends
from weft.sources.growing import GrowingLines
from weft.streaming import live, spans


def _finish(frame, start) -> None:
    """Run a stream to the end of what is there."""
    with spans.with_state(frame.sparkSession):
        start(frame.writeStream.trigger(availableNow=True)).awaitTermination()


def _kept(spark, frame, out: str, key: str, version: str):
    """The newest row of each key that ``frame`` gives."""
    _finish(frame, lambda w: w.outputMode("update").foreachBatch(live.upserting(f"{out}/table", key, version)).option("checkpointLocation", f"{out}/state").start())
    return live.latest(spark, f"{out}/table", key, version)


def _appended(spark, frame, out: str):
    """All rows that ``frame`` gives."""
    _finish(frame, lambda w: w.outputMode("append").format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/table").start())
    return spark.read.schema(frame.schema).parquet(f"{out}/table")


def _line(kind, stamp):
    """A Claude line of a kind; results answer the two calls that a recording begins with."""
    said = lambda type_, content: F.to_json(F.struct(F.lit(type_).alias("type"), stamp.alias("timestamp"), F.struct(F.lit(type_).alias("role"), content.alias("content")).alias("message")))
    result = lambda id_: said("user", F.array(F.struct(F.lit("tool_result").alias("type"), F.lit(id_).alias("tool_use_id"))))
    return F.when(kind == timing.USER, said("user", F.lit("go on"))).when(kind == timing.ASSISTANT, said("assistant", F.array(F.struct(F.lit("text").alias("type"), F.lit("so").alias("text"))))).when(kind == timing.TOOL_RESULT, result("quick")).when(kind == timing.TOOL_WAIT, result("slow")).otherwise(F.to_json(F.struct(F.lit("system").alias("type"), stamp.alias("timestamp"))))


def _stamp(ms):
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _recordings(spark, d):
    """(path, lines) of the events of each user as lines of a recording."""
    rows = timed_events(spark, d).withColumn("line", _line(F.col("kind"), _stamp(F.col("ms"))))
    grouped = rows.groupBy("path").agg(F.min_by("ms", "seq").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]).alias("lines"))
    calls = F.array(*(F.struct(F.lit("tool_use").alias("type"), F.lit(i).alias("id"), F.lit(t).alias("name")) for i, t in (("slow", "Bash"), ("quick", "Read"))))
    head = F.to_json(F.struct(F.lit("assistant").alias("type"), _stamp(F.col("first")).alias("timestamp"), F.struct(F.lit("assistant").alias("role"), calls.alias("content")).alias("message")))
    return grouped.select("path", F.concat(F.array(head), "lines").alias("lines"))


@query("with a as (" + SQL["worked_time"] + "), n as (select user_id as path, count(*) as n from events group by 1) select path, cast(case when path % 5 = 0 then 1 else 0 end as integer) as generation, active_ms, coalesce(at_message_ms, 0) as at_message_ms, n + 1 as n, path % 2 = 0 as half from a join n using (path)")
def stream_growing_files(spark, d):
    """Recordings are written up to the middle of a line, followed, written on (each fifth anew and shorter), and followed
    again from the checkpoint. Every second one ends without a newline."""
    out = shared_folder(spark)
    files = _recordings(spark, d)
    cut = F.floor(F.size("lines") * 2 / 3).cast("int")
    begun = F.concat(F.array_join(F.slice("lines", F.lit(1), cut), "\n"), F.lit("\n"), F.substring(F.get("lines", cut), 1, 25))
    whole = F.concat(F.array_join("lines", "\n"), F.when(F.col("path") % 2 == 0, "").otherwise("\n"))
    name = F.concat(F.lit("s"), F.col("path").cast("string"), F.lit(".jsonl"))
    spark.dataSource.register(GrowingLines)
    for content in (F.when(F.col("path") % 5 == 0, F.concat(whole, F.lit("\n"), whole)).otherwise(begun), whole):
        write_files(files.select(name.alias("path"), content.alias("content")), f"{out}/in")
        lines = spark.readStream.format("growing").option("path", f"{out}/in").option("journal", f"{out}/journal").load()
        grown = spans.growing_worked_time(lines, "claude").withColumn("version", F.col("generation") * F.lit(1 << 40) + F.col("n"))
        found = _kept(spark, grown, out, "path", "version")
    return found.select(F.regexp_extract("path", r"s(\d+)\.jsonl$", 1).cast("long").alias("path"), "generation", "active_ms", F.coalesce("at_message_ms", F.lit(0)).alias("at_message_ms"), "n", "half")


_TYPES = (("view", "call"), ("click", "user"), ("signup", "assistant"))


def _stream_steps(spark, d):
    ev = read(_Streamed(spark), d, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    type_ = F.coalesce(*(F.when(F.col("event_type") == a, b) for a, b in _TYPES), F.lit("tool_result"))
    id_ = F.when(F.col("type").isin("call", "tool_result"), (F.expr("seq div 4") % 9).cast("string"))
    return ev.withColumn("type", type_).withColumns({"tool_use_id": id_, "stop": F.when((F.col("type") == "assistant") & (F.col("seq") % 2 == 0), "end_turn"), "interrupted": (F.col("type") == "user") & (F.col("seq") % 7 == 0)})


@query(f"""with {STEPS_SQL}, base as ({"with " + GENERATING}), seen as (select user_id as path, max(epoch_us(ts) // 1000) as latest from events group by 1), w as (select max(latest) as mark from seen)
  select path, generating and latest + 7200000 > mark as generating, pending, n, latest + 7200000 <= mark as silent from base join seen using (path), w""")
def stream_timed_generating(spark, d):
    """As ``stream_generating``, with sessions silent for two hours no longer at work, by timers of event time."""
    steps = _stream_steps(spark, d).select("path", "seq", "ts", "type", "tool_use_id", "stop", "interrupted")
    timed = spans.timed_generating(steps, idle_ms=7_200_000, forget_ms=604_800_000)
    rows = timed.withColumn("version", F.col("n") * 2 + F.col("silent").cast("int"))
    return _kept(spark, rows, shared_folder(spark), "path", "version").drop("version")


@query("select cast(make_timestamp((epoch_us(ts) // 900000000 - k) * 900000000) as timestamp) as start, event_type, count(*) as n from events, range(4) t(k) group by all")
def stream_sliding_counts(spark, d):
    ev = read(_Streamed(spark), d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = spans.sliding_counts(ev, "event_type").withColumn("key", F.concat_ws("|", "start", "event_type"))
    return _kept(spark, rows, shared_folder(spark), "key", "n").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""with e as (select user_id, ts, case when coalesce(epoch_us(ts) - epoch_us(lag(ts) over w), 1e15) >= 3600000000 then 1 else 0 end as cut from events window w as (partition by user_id order by ts)),
  s as (select user_id, ts, sum(cut) over (partition by user_id order by ts rows unbounded preceding) as k from e), m as (select max(ts) as mark from events)
  select user_id, min(ts) as start, max(ts) + interval 1 hour as stop, count(*) as n from s group by user_id, k having max(ts) + interval 1 hour <= (select mark from m)""")
def stream_session_windows(spark, d):
    """Runs of a user's events less than an hour apart, as far as they are closed when the stream stops."""
    ev = read(_Streamed(spark), d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = _appended(spark, spans.session_windows(ev, "user_id", "1 hour"), shared_folder(spark))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")})


@query(f"""with {EVENTS_SQL}, t as (select *, seq // 4 % 9 as id from ev), c as (select * from t where event_type = 'view'), r as (select * from t where event_type in ('error', 'purchase'))
  select c.path, cast(c.id as bigint) as id, c.seq, r.seq as result_seq, r.ms - c.ms as waited_ms from c join r on c.path = r.path and c.id = r.id and r.ms between c.ms and c.ms + 86400000""")
def stream_answered_calls(spark, d):
    """Views as calls, joined within a day to the errors and purchases of the same user and number."""
    def side(*types):
        ev = read(_Streamed(spark), d, "events").filter(F.col("event_type").isin(*types))
        return ev.select(F.col("user_id").alias("path"), F.expr("event_id div 4 % 9").alias("id"), F.col("event_id").alias("seq"), F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp"))).alias("ts"))

    joined = spans.answered_calls(side("view"), side("error", "purchase"), ["path", "id"], "1 day")
    found = _appended(spark, joined, shared_folder(spark))
    return found.select("path", "id", "seq", "result_seq", (F.unix_millis("result_ts") - F.unix_millis("ts")).alias("waited_ms"))


@query(f"""with {EVENTS_SQL}, x as (select path, seq, event_type, sum(case event_type when 'click' then 1 when 'signup' then -1 else 0 end) over w as a, sum(case event_type when 'view' then 1 when 'click' then 0 when 'signup' then 0 else -1 end) over w as b from ev window w as (partition by path order by seq rows unbounded preceding)),
  y as (select path, arg_max(a, seq) - least(0, min(a)) as tasks, arg_max(b, seq) - least(0, min(b)) as pending, arg_max(event_type, seq) filter (event_type in ('click', 'signup')) as last from x group by path)
  select path, pending > 0 or coalesce(last, '') <> 'signup' or (path % 2 = 0 and tasks > 0) as generating, cast(pending as bigint) as pending from y""")
def tail_states(spark, d):
    """Sessions of two sources whose files are read from their ends: prompts begin turns, signups end them, views are calls."""
    out, t = shared_folder(spark), F.col("event_type")
    kinds = lambda a, b, c, e: F.when(t == "click", a).when(t == "signup", b).when(t == "view", c).otherwise(e)
    codex = F.to_json(F.struct(kinds("event_msg", "event_msg", "response_item", "response_item").alias("type"), F.struct(kinds("task_started", "task_complete", "function_call", "function_call_output").alias("type")).alias("payload")))
    line = F.when(F.col("path") % 2 == 0, codex).otherwise(F.to_json(F.struct(kinds("turn_started", "turn_ended", "tool_started", "tool_completed").alias("type"))))
    whole = timed_events(spark, d).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n").alias("content"))
    write_files(whole.select(F.concat_ws("/", F.when(F.col("path") % 2 == 0, "codex").otherwise("grok"), F.col("path").cast("string")).alias("path"), "content"), out)
    found = []
    for source in ("codex", "grok"):
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(out).select("path").filter(F.col("path").contains(f"/{source}/"))
        found.append(live_state.generating(ends.tails(listed, most=1 << 30), source))
    return found[0].unionByName(found[1]).withColumn("path", F.substring_index("path", "/", -1).cast("long"))
