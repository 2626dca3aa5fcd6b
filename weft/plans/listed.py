"""Queries on chapters as rows, whole messages, lists, time lines, diffs, databases and results by recency."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators import chapter_table, exports, filters, report, search, timing
from weft.operators.tables import kept
from weft.plans.analysis import STEPS_SQL
from weft.plans.base import EVENTS_SQL, query, read, shared_folder, stored_index, timed_events
from weft.plans.exports import _events
from weft.plans.recorded import STEPS, _sources, user_id
from weft.plans.texts import POSTINGS
from weft.sources import recordings

CHAPTERS = STEPS + """, b as (select *, cast(sum(case event_type when 'click' then 1 else 0 end) over w as bigint) as chapter, max(case when event_type in ('signup', 'view') then 1 else 0 end) over w as begun from k window w as (partition by path order by seq rows unbounded preceding)), f as (select * from b where chapter > 0 or begun = 1)"""
TOOL = "list_extract(['Bash', 'Write', 'Read'], {0} + 1)"


def _recorded(spark, d) -> DataFrame:
    """The events of the recordings of all sources, parsed once."""
    return kept(reduce(DataFrame.unionByName, (recordings.events_of(rows, s) for s, rows in _sources(spark, d).items())))


def _pairs(column: str, value: Callable[[Column], Column]) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(column), value)), ",")


@query(f"""with {CHAPTERS}, tc as (select path, chapter, string_agg(tool || '=' || c, ',' order by tool) as tool_counts from (select path, chapter, {TOOL.format('t')} as tool, count(*) as c from f where event_type = 'view' group by all) u group by all),
  fl as (select path, chapter, string_agg(file || ':' || ops, ',' order by file) as files from (select path, chapter, 'src/f' || seq % 7 || '.py' as file, string_agg(case t when 1 then 'Write' else 'Read' end, '+' order by seq) as ops from f where event_type = 'view' and t <> 0 group by all) u group by all),
  ld as (select path, id, arg_max(t, seq) as lt from f where event_type = 'view' group by all), et as (select path, chapter, string_agg(tool || '=' || c, ',' order by tool) as error_tools from (select f.path, chapter, {TOOL.format('lt')} as tool, count(*) as c from f join ld using (path, id) where event_type = 'error' group by all) u group by all),
  z as (select path, chapter, any_value(s) as s, min(seq) filter (event_type = 'click') as asked, arg_min(ms, seq) filter (event_type in ('click', 'signup', 'view')) as started, arg_max(ms, seq) filter (event_type in ('signup', 'view')) as ended, count(*) filter (event_type in ('signup', 'view')) as turns,
    coalesce(sum(case s when 0 then seq % 100 when 4 then seq % 100 + seq % 30 end) filter (event_type = 'signup'), 0) as tokens_in, coalesce(sum(case when s in (0, 4) then seq % 50 end) filter (event_type = 'signup'), 0) as tokens_out, max(seq) filter (event_type = 'signup') as last, count(*) filter (event_type = 'error') as errors from f group by all)
  select path, chapter, coalesce('ask ' || asked, '(subagent session)') as prompt, case when s <> 3 then started end as started, case when s <> 3 then ended end as ended, turns, cast(tokens_in as bigint) as tokens_in, cast(tokens_out as bigint) as tokens_out, 'said ' || last as last_text, coalesce(tool_counts, '') as tool_counts, coalesce(files, '') as files, errors, coalesce(error_tools, '') as error_tools
  from z left join tc using (path, chapter) left join fl using (path, chapter) left join et using (path, chapter)""")
def recorded_chapters(spark, d):
    """The chapters of the recordings of six sources: turns, tokens, tools, files with what was done to them, errors by tool."""
    c = chapter_table.chapter_table(_recorded(spark, d))
    counted = lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))
    return c.select(user_id().alias("path"), "chapter", "prompt", F.unix_millis("started").alias("started"), F.unix_millis("ended").alias("ended"), "turns", "tokens_in", "tokens_out", "last_text", _pairs("tool_counts", counted).alias("tool_counts"), _pairs("files", lambda x: F.concat(x["key"], F.lit(":"), F.array_join(x["value"], "+"))).alias("files"), "errors", _pairs("error_tools", counted).alias("error_tools"))


@query(f"with {CHAPTERS} select distinct path, chapter from f where (event_type = 'view' and t = 0 and seq % 5 = 0) or (event_type = 'click' and contains('ask ' || seq, 'git add'))")
def chapters_by_words(spark, d):
    """Chapters in which something was added and committed, told from what the calls were given."""
    return chapter_table.chapters_holding(_recorded(spark, d), "GIT add . && git").select(user_id().alias("path"), "chapter")


@query("""with s as (select *, c_custkey % 3 as k, substring(sha256(c_name), 1, 8) as h from customer) select c_name as path, h as session_hash, case k when 0 then 'claude' when 1 then 'cursor' else 'claude' end as source, c_mktsegment as project_raw, h as id, c_custkey * 1000 // 1024 as size_kb, c_custkey as mtime,
  case when c_custkey % 2 = 0 and c_custkey % 6 <> 0 then 'p' || c_custkey when c_custkey % 4 <> 0 then 'a title' else '' end as prompt, case when c_custkey % 2 = 0 then 'm' else '' end as model, case when c_custkey % 2 = 0 then 'Bash,Read' else '' end as tools, case when c_custkey % 2 = 0 then c_custkey else 0 end as total, case when k <> 1 then case when c_custkey % 2 = 0 then c_custkey * 10 else 0 end end as duration_ms,
  case when c_custkey % 5 = 0 then 'h' end as host from s""")
def api_rows(spark, d):
    """Customers as sessions, every second with an index row."""
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    sessions = c.select(F.col("c_name").alias("path"), F.when(k % 3 == 0, "claude").when(k % 3 == 1, "cursor").alias("source"), F.col("c_mktsegment").alias("project"), (k * 1000).alias("size"), k.alias("mtime"), F.when(k % 4 != 0, "a title").alias("title"), F.when(k % 5 == 0, "h").alias("host"))
    zero = [F.lit(0).cast("long").alias(n) for n in ("chapters", "input", "output", "cache_read", "errors", "files", "commits")]
    index = c.filter(k % 2 == 0).select(F.col("c_name").alias("path"), F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("p"), k.cast("string"))).alias("first_prompt"), F.lit("m").alias("model"), F.array(F.lit("Bash"), F.lit("Read")).alias("tools"), k.alias("total"), (k * 10).alias("worked_ms"), *zero)
    return chapter_table.api_rows(sessions, index).select("path", "session_hash", "source", "project_raw", "id", "size_kb", "mtime", "prompt", "model", F.array_join("tools", ",").alias("tools"), "total", "duration_ms", "host")


@query(f"""with {EVENTS_SQL}, g as (select path, ms, ms - lag(ms) over w as gap, lag(ms) over w as before from ev where ms is not null window w as (partition by path order by ms, seq)), c as (select *, sum(case when gap >= 3600000 then 1 else 0 end) over (partition by path order by ms rows unbounded preceding) as seg from g),
  ok as (select path from ev group by path having count(ms) >= 3 and max(ms) - min(ms) >= 10000)
  select path, min(ms) as start_ms, max(ms) as end_ms, true as active from c where path in (select path from ok) group by path, seg having max(ms) > min(ms) union all select path, before, ms, false from c where gap >= 3600000 and path in (select path from ok)""")
def activity_timeline(spark, d):
    return timing.activity_segments(timed_events(spark, d), idle=3_600_000)


@query("""select p_partkey, case when p_partkey % 4 = 0 then null when p_partkey % 3 = 0 then 'src/p' || p_partkey || '.py,gone.txt' else 'src/p' || p_partkey || '.py' end as files, case when p_partkey % 4 <> 0 then cast(p_size % 7 as integer) end as added, case when p_partkey % 4 <> 0 then cast(p_size % 5 + case when p_partkey % 3 = 0 then 1 else 0 end as integer) end as removed from part""")
def unified_diffs(spark, d):
    """Diffs of one file or two, the second deleted; every fourth text is none."""
    p, k = read(spark, d, "part"), F.col("p_partkey").cast("string")
    size = F.col("p_size").cast("int")
    head = F.concat(F.lit("diff --git a/x b/x\n--- a/src/p"), k, F.lit(".py\t2025-01-01\n+++ b/src/p"), k, F.lit(".py\n@@ -1,9 +1,9 @@\n context\n"))
    body = F.concat(F.repeat(F.lit("-old\n"), size % 5), F.repeat(F.lit("+new\n"), size % 7))
    text = F.concat(head, body, F.when(F.col("p_partkey") % 3 == 0, "--- a/gone.txt\n+++ /dev/null\n@@ -1 +0,0 @@\n-last\n").otherwise(""))
    found = p.select("p_partkey", chapter_table.diff_summary(F.when(F.col("p_partkey") % 4 == 0, "no diff\n-x\n+y").otherwise(text)).alias("x"))
    return found.select("p_partkey", F.when(F.col("x").isNotNull(), F.array_join("x.files", ",")).alias("files"), "x.added", "x.removed")


@query(f"""with {POSTINGS}, h as (select p.*, count(*) over (partition by term) as df from p where starts_with(term, 'the')), x as (select doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from h join dl using (doc_id), s group by doc_id)
  select doc_id, round(score, 6) as score from x order by doc_id desc limit 20""")
def newest_hits(spark, d):
    """A search whose newest results lead, whatever their score."""
    docs = read(spark, d, "documents")
    found = search.search(docs.withColumn("mtime", F.col("doc_id")), ["the"], index=stored_index(spark, d), newest="mtime")
    return found.select("doc_id", F.round("score", 6).alias("score"))


BLOCKS = STEPS_SQL + """, res as (select distinct path, tool_use_id from st where type = 'tool_result' and seq % 11 <> 0), opened as (select st.*, type = 'call' and r.path is null as open from st left join res r on r.path = st.path and r.tool_use_id = st.tool_use_id and st.type = 'call'),
 b as (select path, seq, 0 as sub, 'user' as role, 'text' as type, text as shown, null as id, null as name, null as command, null as failed from opened where type = 'user' union all select path, seq, 0, 'assistant', 'text', text, null, null, null, null from opened where type = 'assistant'
  union all select path, seq, 0, 'assistant', 'tool_use', null, tool_use_id, tool, input, null from opened where type = 'call' union all select path, seq, 1, 'user', 'tool_result', '(no output recorded)', tool_use_id, null, null, null from opened where open
  union all select path, seq, 0, 'user', case when seq % 11 = 0 then 'text' else 'tool_result' end, case when seq % 11 = 0 then '[session error] ' || text else text end, case when seq % 11 <> 0 then tool_use_id end, null, null, case when seq % 11 <> 0 and is_error then true end from opened where type = 'tool_result')"""


@query(f"""with {BLOCKS}, f as (select *, case when role = lag(role) over w and role <> 'assistant' then 0 else 1 end as flip from b window w as (partition by path order by seq, sub)), i as (select *, cast(sum(flip) over (partition by path order by seq, sub rows unbounded preceding) as bigint) as message from f)
  select path, message, cast(row_number() over (partition by path, message order by seq, sub) - 1 as integer) as at, role, type, shown, case when type = 'tool_use' then id end as id, name, command, case when type = 'tool_result' then id end as tool_use_id, failed from i""")
def anthropic_blocks(spark, d):
    """Every field of every block: texts, calls with their input, results with what they answer."""
    out = exports.anthropic_messages(_events(spark, d))
    kind = "array<struct<type:string,text:string,id:string,name:string,input:struct<command:string>,tool_use_id:string,content:string,is_error:boolean>>"
    blocks = out.select("path", "message", "role", F.posexplode(F.from_json("content", kind)).alias("at", "x"))
    return blocks.select("path", "message", "at", "role", "x.type", F.coalesce("x.text", "x.content").alias("shown"), "x.id", "x.name", "x.input.command", "x.tool_use_id", F.col("x.is_error").alias("failed"))


@query(f"""with {BLOCKS} select path, cast(row_number() over (partition by path order by seq, sub) as bigint) as message, case when type = 'tool_result' then 'tool' else role end as role, shown as content, case when type = 'tool_result' then id end as tool_call_id, case when type = 'tool_use' then id end as call_id, name, case when type = 'tool_use' then 'function' end as kind, command from b""")
def openai_fields(spark, d):
    """Every field of every message: content, the call that a result answers, calls with name and arguments."""
    out = exports.openai_messages(_events(spark, d))
    m = F.from_json("content", "struct<role:string,content:string,tool_call_id:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>>")
    call = F.get("m.tool_calls", F.lit(0))
    return out.withColumn("m", m).select("path", "message", "m.role", "m.content", "m.tool_call_id", call["id"].alias("call_id"), call["function"]["name"].alias("name"), call["type"].alias("kind"), F.get_json_object(call["function"]["arguments"], "$.command").alias("command"))


def _databases(rows: DataFrame, folder: str, table: str) -> None:
    """Write ``rows`` as a table of SQLite databases, one for each partition."""
    columns = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import sqlite3
        import tempfile
        from contextlib import closing

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        with tempfile.TemporaryDirectory() as own:
            file = os.path.join(own, "db")
            with closing(sqlite3.connect(file)) as db:
                db.execute(f"create table {table} ({', '.join(columns)})")
                for batch in batches:
                    db.executemany(f"insert into {table} values ({', '.join('?' * len(columns))})", batch.astype(object).where(batch.notna(), None).values.tolist())
                db.commit()
            with open(file, "rb") as data, store.open_output_stream(f"{base}/{uuid.uuid4().hex}.db") as out:
                while piece := data.read(1 << 20):
                    out.write(piece)
        yield pd.DataFrame({"done": [1]})

    rows.mapInPandas(run, "done int").write.format("noop").mode("overwrite").save()


@query("""with c as (select conv_id, turn, role, text from conversations where role in ('user', 'assistant')) select conv_id, turn, role as type, case when role = 'assistant' then trim(coalesce(text, '')) else trim(text) end as text, case when role = 'assistant' then 'model-' || turn % 2 end as model from c where role = 'assistant' or (trim(coalesce(text, '')) <> '' and not starts_with(trim(text), '<'))""")
def database_messages(spark, d):
    """Conversations as messages and parts in databases, read back by four readers each and joined."""
    out, k = shared_folder(spark), F.col("conv_id")
    c = read(spark, d, "conversations").filter("role in ('user', 'assistant')")
    id_ = F.concat_ws("-", k.cast("string"), "turn")
    at = F.lit(1_750_000_000_000) + F.col("turn") * 1000
    data = F.to_json(F.struct("role", F.when(F.col("role") == "assistant", F.concat(F.lit("model-"), (F.col("turn") % 2).cast("string"))).alias("modelID"), F.struct(at.alias("created")).alias("time")))
    messages = c.select(id_.alias("id"), k.cast("string").alias("session_id"), at.alias("time_created"), data.alias("data"))
    parts = c.select(F.concat(F.lit("p"), id_).alias("id"), id_.alias("message_id"), at.alias("time_created"), F.to_json(F.struct(F.lit("text").alias("type"), "text")).alias("data"))
    _databases(messages.repartition(4, "session_id"), f"{out}/message", "message")
    _databases(parts.repartition(4, "message_id"), f"{out}/part", "part")
    spark.dataSource.register(recordings.SqliteSource)
    table = lambda name, schema: spark.read.format("sqlite").schema(schema).option("path", f"{out}/{name}/*.db").option("dbtable", name).option("numpartitions", "4").load()
    found = recordings.opencode(table("message", "id string, session_id string, time_created long, data string"), table("part", "id string, message_id string, time_created long, data string"))
    return found.select(F.col("path").cast("long").alias("conv_id"), (F.unix_millis("ts") / 1000 - 1_750_000_000).cast("long").alias("turn"), "type", "text", "model")


@query("select c_name as id, 'model-' || c_custkey % 3 as model from customer where c_custkey % 4 <> 0 and c_custkey % 5 <> 0")
def cursor_models(spark, d):
    """The models that an editor's state database has for its sessions; some have none, and other keys lie between."""
    out, k = shared_folder(spark), F.col("c_custkey")
    key = F.concat(F.when(k % 4 == 0, "bubbleId:").otherwise("composerData:"), "c_name")
    value = F.when(k % 5 == 0, F.lit('{"modelConfig":{"modelName":""}}')).otherwise(F.to_json(F.struct(F.struct(F.concat(F.lit("model-"), (k % 3).cast("string")).alias("modelName")).alias("modelConfig"))))
    _databases(read(spark, d, "customer").select(key.alias("key"), value.alias("value")).repartition(2), f"{out}/db", "cursorDiskKV")
    spark.dataSource.register(recordings.SqliteSource)
    pairs = spark.read.format("sqlite").schema("key string, value string").option("path", f"{out}/db/*.db").option("dbtable", "cursorDiskKV").load()
    return recordings.cursor_models(pairs)


NL = "chr(10)"


@query(f"""with {CHAPTERS}, rs as (select path, id, arg_max(event_type, seq) as rt from f where event_type in ('error', 'purchase') group by all),
  cm as (select f.path, f.chapter, f.seq, case when f.seq % 5 = 0 then 'git add . && git commit -m x' else 'ls' end as cmd, coalesce(rt = 'error', false) as bad, case when rt = 'error' then case when s = 1 then 'Process exited with code 1' || {NL} || 'Error: it failed' else 'Error: it failed' end when rt = 'purchase' then 'fine' else '' end as out from f left join rs using (path, id) where event_type = 'view' and t = 0),
  cn as (select *, row_number() over (partition by path, chapter order by seq) as n, sum(bad::int) over (partition by path, chapter order by seq) as nb from cm),
  ct as (select path, chapter, string_agg('**[' || case when bad then 'FAIL' else 'ok' end || ']** `' || cmd || '`' || case when out <> '' then {NL} || {NL} || '```' || {NL} || out || {NL} || '```' else '' end, {NL} || {NL} order by n) filter (n <= 12) || case when count(*) > 12 then {NL} || {NL} || '*...and ' || (count(*) - 12) || ' more commands*' else '' end as commands,
    string_agg('- `' || cmd || '`' || {NL} || '  > ' || string_split(out, {NL})[1], {NL} order by n) filter (bad and nb <= 5) as errors from cn group by all),
  fo as (select path, chapter, 'src/f' || seq % 7 || '.py' as file, case t when 1 then 'write' else 'read' end as op, count(*) as c, min(seq) as begun_at from f where event_type = 'view' and t <> 0 group by all), fp as (select path, chapter, file, string_agg(op || case when c > 1 then ' x' || c else '' end, ', ' order by begun_at) as ops from fo group by all),
  fl as (select path, chapter, string_agg('- `' || file || '` — ' || ops, {NL} order by file) as files from fp group by all), z as (select path, chapter, any_value(s) as s, min(seq) filter (event_type = 'click') as asked, arg_min(ms, seq) filter (event_type in ('click', 'signup', 'view')) as started, arg_max(ms, seq) filter (event_type in ('signup', 'view')) as ended, count(*) filter (event_type in ('signup', 'view')) as turns, max(seq) filter (event_type = 'signup') as last from f group by all),
  y as (select *, row_number() over (partition by path order by chapter) as number, case when s <> 3 and ended - started > 1000 then (ended - started) // 1000 end as span from z left join ct using (path, chapter) left join fl using (path, chapter)),
  a as (select *, concat_ws(' | ', case when turns > 0 then turns || case when turns = 1 then ' turn' else ' turns' end end, case when span >= 3600 then span // 3600 || 'h ' || span % 3600 // 60 || 'm' when span >= 60 then span // 60 || 'm ' || span % 60 || 's' else span || 's' end) as about from y)
  select path, chapter, '## Chapter ' || number || {NL} || {NL} || '> ' || coalesce('ask ' || asked, '(subagent session)') || {NL} || {NL} || case when about <> '' then '*' || about || '*' || {NL} || {NL} else '' end || coalesce('### Files' || {NL} || {NL} || files || {NL} || {NL}, '') || coalesce('### Commands' || {NL} || {NL} || commands || {NL} || {NL}, '')
   || coalesce('### Errors' || {NL} || {NL} || errors || {NL} || {NL}, '') || coalesce('### Response' || {NL} || {NL} || 'said ' || last || {NL} || {NL}, '') || '---' || {NL} as markdown from a""")
def report_chapters(spark, d):
    """The chapters of the recordings of six sources as sections of a report."""
    return report.chapter_sections(_recorded(spark, d)).select(user_id().alias("path"), "chapter", "markdown")


@query("select conv_id, count(*) as messages, count(*) * 1024 as size from conversations group by conv_id having count(*) >= 3")
def database_sessions(spark, d):
    """Sessions of a database with enough messages, joined to them; a size is made of their number."""
    c = read(spark, d, "conversations")
    sessions = c.groupBy("conv_id").agg(F.max("turn").alias("time_updated")).select(F.col("conv_id").alias("id"), "time_updated")
    found = recordings.opencode_sessions(sessions, c.select(F.col("conv_id").alias("session_id")), most=2**31 - 1)
    return found.select(F.col("id").alias("conv_id"), "messages", "size")


@query("with h as (select c_name, substring(sha256(c_name), 1, 8) as h, c_custkey from customer) select c_name, c_custkey % 9 = 0 or h = (select min(h) from h) as found from h")
def named_or_found(spark, d):
    """Rows that the first hash names, or that an index found."""
    c = read(spark, d, "customer").select(F.col("c_name").alias("path"), "c_custkey")
    named = c.agg(F.min(F.substring(F.sha2("path", 256), 1, 8))).first()[0]
    return c.select(F.col("path").alias("c_name"), filters.free_text(named, F.when(F.col("c_custkey") % 9 == 0, True)).alias("found"))
