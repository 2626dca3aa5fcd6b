"""Queries on whole recordings: events are written as calls, results, texts with usage and broken lines of six sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.recorded_index import recorded_index
from weft.plans.base import EVENTS_SQL, query, shared_folder, timed_events
from weft.plans.recordings import write_files
from weft.sources import recordings

SOURCES = ["claude", "codex", "factory", "cursor", "dsh", "fx"]
TOOLS = ["Bash", "Write", "Read"]


def _obj(**fields: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def _json(**fields: Column) -> Column:
    return F.to_json(_obj(**fields))


def _lines(spark, d) -> DataFrame:
    """(path, seq, line): what each event of a user is in the form of the user's source, with lines of no meaning between."""
    ev = timed_events(spark, d).select("path", "seq", "ms", "event_type")
    s, k, t = F.lit, F.col("seq"), F.col("event_type")
    tool = F.get(F.array(*map(s, TOOLS)), (k % 3).cast("int"))
    id_ = (F.expr("seq div 4") % 9).cast("string")
    command, file = F.when(k % 5 == 0, "git add . && git commit -m x").otherwise("ls"), F.concat(s("/src/f"), (k % 7).cast("string"), s(".py"))
    given = F.when(k % 3 == 0, _json(command=command)).otherwise(_json(file_path=file, path=file))
    parsed = F.from_json(given, "command string, file_path string, path string")
    failed = t == "error"
    said, asked = F.concat(s("said "), k.cast("string")), F.concat(s("ask "), k.cast("string"))
    answer = F.when(failed, "Error: it failed").otherwise("fine")
    stamp = F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    part = F.expr("seq div 8").cast("string")
    kinds = lambda user, text, call, result: F.when(t == "click", user).when(t == "signup", text).when(t == "view", call).otherwise(result)
    text_block = lambda x: F.array(_obj(type=s("text"), text=x))
    use, outcome = F.array(_obj(type=s("tool_use"), id=id_, name=tool, input=parsed)), F.array(_obj(type=s("tool_result"), tool_use_id=id_, content=answer, is_error=failed))
    usage = _obj(input_tokens=k % 100, output_tokens=k % 50, cache_read_input_tokens=k % 30, cache_creation_input_tokens=k % 20)
    claude = lambda role, content, **more: _json(type=s(role), timestamp=stamp, requestId=F.concat(s("r"), part), message=_obj(role=s(role), content=content, **more))
    codex = lambda **payload: _json(timestamp=stamp, type=s("response_item"), payload=_obj(**payload))
    total = _obj(input_tokens=k, output_tokens=k % 50, cached_input_tokens=k % 30)
    counted = F.concat(_json(type=s("turn_context"), payload=_obj(model=F.concat(s("gpt-"), (k % 2).cast("string")))), s("\n"), _json(type=s("event_msg"), payload=_obj(type=s("token_count"), info=_obj(total_token_usage=total))), s("\n"))
    factory = lambda role, content: _json(type=s("message"), timestamp=stamp, message=_obj(role=s(role), content=content))
    cursor = lambda role, content: _json(role=s(role), message=_obj(content=content))
    dsh = lambda kind, **data: _json(type=s(kind), time=F.col("ms"), data=_obj(**data))
    fx = lambda **event: _json(timestamp_ms=F.col("ms"), event=_obj(**event))
    summary = _obj(turn_duration_ms=k % 1000, token_progress=_obj(input_tokens=k % 100, output_tokens=k % 50))
    own = [
        kinds(claude("user", asked), claude("assistant", text_block(said), id=F.concat(s("m"), part), model=F.concat(s("claude-"), (k % 2).cast("string")), usage=usage), claude("assistant", use), claude("user", outcome)),
        kinds(codex(type=s("message"), role=s("user"), content=F.array(_obj(type=s("input_text"), text=asked))), F.concat(counted, codex(type=s("message"), role=s("assistant"), content=F.array(_obj(type=s("output_text"), text=said)))), codex(type=s("function_call"), name=tool, call_id=id_, arguments=given), codex(type=s("function_call_output"), call_id=id_, output=F.when(failed, "Process exited with code 1\nError: it failed").otherwise("fine"))),
        kinds(factory("user", text_block(asked)), factory("assistant", text_block(said)), factory("assistant", use), factory("user", outcome)),
        kinds(cursor("user", text_block(asked)), cursor("assistant", text_block(said)), cursor("assistant", use), cursor("user", outcome)),
        kinds(
            dsh("user/message", source=_obj(kind=s("user")), content=text_block(asked)), dsh("assistant/message", message=_obj(content=text_block(said), source=_obj(model=F.concat(s("d-"), (k % 2).cast("string")))), usage=_obj(inputTokens=k % 100, outputTokens=k % 50, cacheReadTokens=k % 30)),
            dsh("assistant/message", message=_obj(content=F.array(_obj(type=s("tool-call"), id=id_, name=tool, arguments=given)))), dsh("tool/result", message=_obj(content=text_block(answer), toolCallId=id_, isError=failed)),
        ),
        kinds(fx(user=_obj(text=asked)), F.concat(fx(assistant=_obj(text=said)), s("\n"), fx(turn_completed=_obj(turn_summary=summary))), fx(tool_call=_obj(call_id=id_, tool_name=tool, arguments_json=given)), fx(tool_result=_obj(call_id=id_, tool_name=tool, status=F.when(failed, "error").otherwise("success"), preview=answer))),
    ]
    line = F.coalesce(*(F.when(F.col("path") % len(own) == i, x) for i, x in enumerate(own)))
    noise = F.when(k % 6 == 0, '\n{"type":"assistant","message":{"content":[{"type":"tool_use","na').when(k % 6 == 1, '\n\n{"type":"progress","data":{"text":"on the way"}}').when(k % 6 == 2, "\nno json at all").otherwise("")
    return ev.select("path", "seq", F.concat(line, noise).alias("line"))


def _written(spark, d) -> str:
    folder = shared_folder(spark)
    whole = _lines(spark, d).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("content"))
    source = F.get(F.array(*map(F.lit, SOURCES)), (F.col("path") % len(SOURCES)).cast("int"))
    write_files(whole.select(F.concat(source, F.lit("/s"), F.col("path").cast("string"), F.lit(".jsonl")).alias("path"), "content"), folder)
    return folder


def _sources(spark, d) -> dict[str, DataFrame]:
    """The lines of each source that has recordings."""
    present = {SOURCES[r["s"]] for r in timed_events(spark, d).select((F.col("path") % len(SOURCES)).cast("int").alias("s")).distinct().collect()}  # at most six
    folder = _written(spark, d)
    return {s: recordings.lines(spark, f"{folder}/{s}") for s in SOURCES if s in present}


def user_id() -> Column:
    return F.regexp_extract("path", r"s(\d+)\.jsonl$", 1).cast("long")


STEPS = EVENTS_SQL + """, k as (select *, path % 6 as s, cast(seq // 4 % 9 as varchar) as id, seq % 3 as t, row_number() over (partition by path order by seq) as n from ev)"""


@query(f"""with {STEPS} select path, n, list_extract(['claude', 'codex', 'factory', 'cursor', 'dsh', 'fx'], s + 1) as source, case event_type when 'click' then 'user' when 'signup' then 'assistant' when 'view' then 'assistant' else 'tool_result' end as type, case when s <> 3 then ms end as ms,
  case event_type when 'click' then 'ask ' || seq when 'signup' then 'said ' || seq when 'view' then '' when 'error' then case when s = 1 then 'Process exited with code 1' || chr(10) || 'Error: it failed' else 'Error: it failed' end else 'fine' end as text,
  case when event_type = 'view' then list_extract(['Bash', 'Write', 'Read'], t + 1) end as tool, case when event_type = 'view' then id end as call_id, case when event_type = 'view' then case when t <> 0 then '/src/f' || seq % 7 || '.py' when seq % 5 = 0 then 'git add . && git commit -m x' else 'ls' end end as given,
  case when event_type in ('error', 'purchase') then id end as answers, case when event_type in ('error', 'purchase') then event_type = 'error' end as failed, case when event_type = 'signup' and s = 0 then 'claude-' || seq % 2 when event_type = 'signup' and s = 4 then 'd-' || seq % 2 end as model,
  case when event_type = 'signup' and s = 0 then seq % 100 when event_type = 'signup' and s = 4 then seq % 100 + seq % 30 when event_type = 'view' and s = 4 then 0 end as tokens_in, case when event_type = 'signup' and s in (0, 4) then seq % 50 when event_type = 'view' and s = 4 then 0 end as tokens_out from k""")
def recorded_steps(spark, d):
    """Every event of six readers: prompts, texts with model and usage, calls, results, failures; broken lines are skipped."""
    from pyspark.sql import Window

    every = reduce(DataFrame.unionByName, (recordings.events_of(rows, s) for s, rows in _sources(spark, d).items()))
    call = F.get("tool_calls", F.lit(0))
    given = F.from_json(call["input"], "command string, file_path string")
    n = F.row_number().over(Window.partitionBy("path").orderBy("seq")).cast("long")
    answers, failed = F.when(F.col("type") == "tool_result", F.col("tool_use_id")), F.when(F.col("type") == "tool_result", F.col("is_error"))
    return every.select(user_id().alias("path"), n.alias("n"), "source", "type", F.unix_millis("ts").alias("ms"), "text", call["name"].alias("tool"), call["id"].alias("call_id"), F.coalesce(given["command"], given["file_path"]).alias("given"), answers.alias("answers"), failed.alias("failed"), "model", F.col("usage.input").alias("tokens_in"), F.col("usage.output").alias("tokens_out"))


@query(f"""with {STEPS}, c as (select *, case when event_type in ('error', 'purchase') then last_value(case when event_type = 'view' then t end ignore nulls) over (partition by path, id order by seq rows between unbounded preceding and 1 preceding) end as of_tool from k),
  w as (select *, case event_type when 'click' then 1 when 'signup' then 2 when 'view' then 2 else case when of_tool = 0 then 5 else 3 end end as what from c), g as (select *, ms - max(ms) over (partition by path order by seq rows between unbounded preceding and 1 preceding) as gap, lag(what) over (partition by path order by seq) as last_what from w),
  a as (select path, cast(coalesce(sum(gap) filter (gap > 0 and (gap <= 300000 or (what = 5 and gap <= 21600000) or (what = 2 and last_what in (3, 5) and gap <= 1800000))), 0) as bigint) as active from g group by path),
  r as (select path, seq // 8 as part, max(seq % 100 + seq % 30 + seq % 20) as whole, max(seq % 50) as o, max(seq % 30) as h, max(seq % 20) as w from k where event_type = 'signup' and s = 0 group by all), ra as (select path, sum(whole) as whole, sum(o) as o, sum(h) as h, sum(w) as w from r group by path),
  tl as (select path, string_agg(tool, ',' order by f) as tools from (select path, list_extract(['Bash', 'Write', 'Read'], t + 1) as tool, min(seq) as f from k where event_type = 'view' group by all) u group by path),
  z as (select path, any_value(s) as s, arg_min('ask ' || seq, seq) filter (event_type = 'click') as first_prompt, arg_min(seq % 2, seq) filter (event_type = 'signup') as m, count(*) filter (event_type = 'click') as chapters, count(*) filter (event_type = 'error') as errors,
    count(distinct seq % 7) filter (event_type = 'view' and t <> 0) as files, count(*) filter (event_type = 'view' and t = 0 and seq % 5 = 0) as commits, max(seq) filter (event_type = 'signup') as last, coalesce(sum(seq % 100) filter (event_type = 'signup'), 0) as i, coalesce(sum(seq % 50) filter (event_type = 'signup'), 0) as o, coalesce(sum(seq % 30) filter (event_type = 'signup'), 0) as h,
    coalesce(sum(seq % 1000) filter (event_type = 'signup'), 0) as said, coalesce(sum(length('ask ' || seq)) filter (event_type = 'click'), 0) as ic, coalesce(sum(length('said ' || seq)) filter (event_type = 'signup'), 0) + coalesce(sum(case t when 1 then 25 else 24 end) filter (event_type = 'view'), 0) as oc from k group by path),
  y as (select z.*, coalesce(tools, '') as tools, case s when 0 then coalesce(whole - ra.h - ra.w, 0) when 1 then coalesce(last, 0) when 4 then i when 5 then i else cast(floor(ic / 4 + 0.5) as bigint) end as tin, case s when 0 then coalesce(ra.o, 0) when 1 then coalesce(last % 50, 0) when 4 then z.o when 5 then z.o else cast(floor(oc / 4 + 0.5) as bigint) end as tout,
    case s when 0 then coalesce(ra.h, 0) when 1 then coalesce(last % 30, 0) when 4 then z.h else 0 end as tread, coalesce(whole, 0) + coalesce(ra.o, 0) as tall, active from z left join ra using (path) left join tl using (path) join a using (path))
  select path, first_prompt, case s when 0 then 'claude-' || m when 1 then 'gpt-' || m when 4 then 'd-' || m end as model, tools, chapters, cast(tin as bigint) as input, cast(tout as bigint) as output, cast(tread as bigint) as cache_read, cast(case s when 0 then tall else tin + tout end as bigint) as total, s in (2, 3) as estimated, errors, files, commits,
   cast(case s when 3 then 0 when 5 then said else active end as bigint) as worked_ms from y""")
def recorded_session_index(spark, d):
    """The index row of each of these recordings, by the conventions of its source."""
    every = reduce(DataFrame.unionByName, (recorded_index(rows, s) for s, rows in _sources(spark, d).items()))
    return every.withColumns({"path": user_id(), "tools": F.array_join("tools", ","), "chapters": F.col("chapters").cast("long")}).drop("tool_counts")
