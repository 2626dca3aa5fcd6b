"""Queries on readers: conversations are written as recordings of seven sources, found again and read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.plans.base import query, read, shared_folder
from weft.sources import discovery, recordings

SOURCES = ["claude", "cursor", "codex", "factory", "grok", "fx", "dsh"]


def write_files(files: DataFrame, folder: str) -> None:
    """Write (path, content) as files below ``folder``; content of paths that end in .zstd is compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                data = content.encode()
                if path.endswith(".zstd"):
                    import zstandard

                    first, rest = data.split(b"\n", 1)
                    data = zstandard.compress(first + b"\n") + zstandard.compress(rest)
                store.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{base}/{path}") as out:
                    out.write(data)
            yield pa.RecordBatch.from_arrays([batch.column("path")], ["path"])

    files.select("path", "content").mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


def _recorded(spark, d) -> dict[str, str]:
    """Write the recordings of this run to the shared folder; the folder of each source."""
    k, c = F.col("conv_id"), F.lit
    said = read(spark, d, "conversations").filter("role in ('user', 'assistant') and trim(text) <> ''").select("conv_id", "turn", "role", "text", (k % len(SOURCES)).alias("s"))
    text, role = F.col("text"), F.col("role")
    block = F.array(F.struct(c("text").alias("type"), text.alias("text")))
    at = F.lit(1_750_000_000_000) + F.col("turn") * 1000
    stamp = F.date_format(F.timestamp_millis(at), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    user = role == "user"
    line = [
        F.to_json(F.struct(role.alias("type"), stamp.alias("timestamp"), F.struct(role.alias("role"), text.alias("content")).alias("message"))),
        F.to_json(F.struct(role.alias("role"), F.struct(block.alias("content")).alias("message"))),
        F.to_json(F.struct(stamp.alias("timestamp"), c("response_item").alias("type"), F.struct(c("message").alias("type"), role.alias("role"), block.alias("content")).alias("payload"))),
        F.to_json(F.struct(c("message").alias("type"), F.struct(role.alias("role"), text.alias("content")).alias("message"))),
        F.to_json(F.struct(role.alias("type"), text.alias("content"))),
        F.to_json(F.struct(at.alias("timestamp_ms"), F.struct(F.when(user, F.struct(text.alias("text"))).alias("user"), F.when(~user, F.struct(text.alias("text"))).alias("assistant")).alias("event"))),
        F.when(user, F.to_json(F.struct(c("user/message").alias("type"), at.alias("time"), F.struct(F.struct(c("user").alias("kind")).alias("source"), block.alias("content")).alias("data")))).otherwise(F.to_json(F.struct(c("assistant/message").alias("type"), at.alias("time"), F.struct(F.struct(block.alias("content")).alias("message")).alias("data")))),
    ]
    line = F.coalesce(*(F.when(F.col("s") == i, x) for i, x in enumerate(line)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n")
    whole = said.groupBy("conv_id", "s").agg(body.alias("body"))
    at_ = lambda *parts: F.concat(*(c(p) if isinstance(p, str) else p.cast("string") for p in parts))
    path = [
        F.when(k % 2 == 0, at_("claude/p", k % 3, "/s", k, ".jsonl")).otherwise(at_("claude/p", k % 3, "/main", k, "/subagents/a", k, ".jsonl")),
        at_("cursor/p", k % 3, "/agent-transcripts/u", k, "/u", k, ".jsonl"), at_("codex/2025/0", k % 9 + 1, "/rollout-", k, ".jsonl"), at_("factory/-home-me-code-f", k % 3, "/t", k, ".jsonl"),
        at_("grok/%2Fhome%2Fme%2Fcode%2Fg", k % 3, "/id", k, "/chat_history.jsonl"), at_("fx/x", k, "/events.jsonl"), at_("dsh/slug/d", k, "/session.v2.jsonl.zstd"),
    ]
    head = F.when(F.col("s") == 2, at_('{"timestamp":"2025-01-01T00:00:00Z","type":"session_meta","payload":{"cwd":"/home/me/code/c', k % 4, '"}}\n')).when(F.col("s") == 6, at_('{"type":"session","cwd":"/home/me/code/d', k % 4, '"}\n')).otherwise("")
    files = whole.select(F.coalesce(*(F.when(F.col("s") == i, x) for i, x in enumerate(path))).alias("path"), F.concat(head, "body").alias("content"))
    beside = whole.filter("s = 5").select(at_("fx/x", k, "/session.json").alias("path"), at_('{"workspace_root":"/home/me/code/w', k % 4, '/","subagent_child":true}').alias("content")).unionByName(whole.filter("s = 5 and conv_id % 2 = 0").select(at_("fx/x", k, "/subagent/owner.json").alias("path"), at_('{"parent_id":"x', k + 1, '"}').alias("content")))
    older = whole.filter("s = 6").select(at_("dsh/slug/d", k, "/session.v1.jsonl.zstd").alias("path"), F.concat(c('{"type":"session","cwd":"/old"}\n'), "body").alias("content"))
    folder = shared_folder(spark)
    write_files(files.unionByName(beside).unionByName(older), folder)
    return {s: f"{folder}/{s}" for s in SOURCES}


SAID = """said as (select conv_id, turn, role, text, conv_id % 7 as s, list_extract(['claude', 'cursor', 'codex', 'factory', 'grok', 'fx', 'dsh'], conv_id % 7 + 1) as source from conversations where role in ('user', 'assistant') and trim(text) <> '')"""


@query(f"""with {SAID}, w as (select distinct conv_id as k, s, source from said) select source, case s when 0 then 'p' || k % 3 when 1 then 'p' || k % 3 when 2 then 'c' || k % 4 when 3 then 'f' || k % 3 when 4 then 'g' || k % 3 when 5 then 'w' || k % 4 else 'd' || k % 4 end as project,
  case s when 0 then case when k % 2 = 0 then 's' || k || '.jsonl' else 'a' || k || '.jsonl' end when 1 then 'u' || k || '.jsonl' when 2 then 'rollout-' || k || '.jsonl' when 3 then 't' || k || '.jsonl' when 4 then 'id' || k when 5 then 'x' || k else 'd' || k end as file,
  case when s = 0 and k % 2 = 1 then 'main' || k when s = 5 and k % 2 = 0 then 'x' || (k + 1) end as parent_session from w""")
def discovered_sessions(spark, d):
    roots = _recorded(spark, d)
    grok = discovery.grok(spark, roots.pop("grok"), home="/home/me")
    found = discovery.discover(spark, roots).drop("host").unionByName(grok)
    return found.select("source", "project", "file", "parent_session")


@query(f"""with {SAID}, e as (select source, conv_id, turn, role, case when source = 'grok' and role = 'user' then trim(regexp_replace(text, '\\s+', ' ', 'g')) when source in ('fx', 'dsh') and role = 'user' then trim(text) else text end as text from said)
  select source, role as type, count(*) as n, count(distinct conv_id) as sessions, bit_xor(cast('0x' || substring(md5(text), 1, 12) as bigint)) as texts from e group by all""".replace("\\\\", "\\"))
def recorded_events(spark, d):
    roots = _recorded(spark, d)
    deep = {"claude": "/{*,*/*/*}/*.jsonl", "cursor": "/*/*/*/*.jsonl", "codex": "/*/*/*.jsonl", "factory": "/*/*.jsonl", "grok": "/*/*/chat_history.jsonl", "fx": "/*/events.jsonl", "dsh": "/*/*/session.v2.jsonl.zstd"}
    rows = recordings.read_all(spark, {s: root + deep[s] for s, root in roots.items()})
    h = F.conv(F.substring(F.md5("text"), 1, 12), 16, 10).cast("long")
    return rows.groupBy("source", "type").agg(F.count("*").alias("n"), F.count_distinct("path").alias("sessions"), F.bit_xor(h).alias("texts"))


def _lines(spark, d) -> DataFrame:
    """Events as lines of one recording for each user."""
    e = read(spark, d, "events")
    line = F.to_json(F.struct(F.col("event_type").alias("type"), "event_id", "props"))
    return e.select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), line.alias("line"))


LINES = """l as (select user_id as path, event_id as seq, event_type, '{"type":"' || event_type || '","event_id":' || event_id || ',"props":' || cast(to_json(props) as varchar) || '}' as line from events)"""


@query(f"with {LINES}, t as (select *, sum(length(line) + 1) over (partition by path order by seq) as upto from l where seq < 4096) select path, seq from t where upto <= 4096")
def recording_heads(spark, d):
    return recordings.head(_lines(spark, d), 4096).select("path", "seq")


@query(f"with {LINES}, c as (select path, seq, case when seq % 4 = 1 and seq = max(seq) over (partition by path) then substring(line, 1, 20) else line end as line, max(seq) over (partition by path) as last from l), t as (select *, coalesce(sum(length(line) + 1) over (partition by path order by seq desc rows between unbounded preceding and 1 preceding), 0) as behind from c) select path, seq, last % 4 = 1 as mid_write from t where behind = 0 or behind + length(line) + 1 <= 1000")
def recording_tails(spark, d):
    """Every fourth recording is cut within its last line."""
    from pyspark.sql import Window

    last = F.max("seq").over(Window.partitionBy("path"))
    cut = _lines(spark, d).withColumn("line", F.when((F.col("seq") % 4 == 1) & (F.col("seq") == last), F.substring("line", 1, 20)).otherwise(F.col("line")))
    return recordings.tail(cut, 1000).select("path", "seq", "mid_write")


@query("select s.source, count(*) filter (case s.source when 'factory' then false when 'codex' then false when 'dsh' then false when 'claude' then true else true end) as n from events, (values ('claude'), ('factory'), ('codex'), ('dsh'), ('grok')) s(source) group by 1".replace("from events, (values", "from events cross join (values"))
def indexed_lines(spark, d):
    """Which lines each source's gate lets through before JSON is parsed."""
    rows = _lines(spark, d)
    counts = rows.agg(*(F.count_if(recordings.indexed(s, F.col("line"))).alias(s) for s in ("claude", "factory", "codex", "dsh", "grok")))
    return counts.unpivot([], ["claude", "factory", "codex", "dsh", "grok"], "source", "n")


@query("""with m as (select o_orderkey as id, o_custkey as path, o_orderkey % 2 = 0 as asked from orders), r as (select path, m.id, asked, l_linenumber as k, l_returnflag as f, l_partkey as call from m left join lineitem on l_orderkey = m.id),
  e as (select path, 'user' as type, array_to_string(list('p' || call order by k, call), chr(10)) as text, false as is_error from r where asked and call is not null group by path, id union all select path, 'assistant', '', false from m where not asked union all select path, 'tool_result', case when f = 'R' then 'boom ' || call else 'fine' end, f = 'R' from r where not asked and call is not null)
  select path, type, count(*) as n, count(*) filter (is_error) as errors, bit_xor(cast('0x' || substring(md5(text), 1, 12) as bigint)) as texts from e group by all""")
def message_parts(spark, d):
    """Orders as messages, their line items as parts."""
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    asked = F.col("o_orderkey") % 2 == 0
    message = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("session_id"), F.col("o_orderkey").alias("time_created"), F.to_json(F.struct(F.when(asked, "user").otherwise("assistant").alias("role"), F.lit("m1").alias("modelID"))).alias("data"))
    bad = F.col("l_returnflag") == "R"
    tool = F.to_json(F.struct(F.lit("tool").alias("type"), F.col("l_partkey").cast("string").alias("callID"), F.lit("bash").alias("tool"), F.struct(F.when(bad, "error").otherwise("completed").alias("status"), F.when(~bad, "fine").alias("output"), F.when(bad, F.concat(F.lit("boom "), F.col("l_partkey"))).alias("error")).alias("state")))
    data = F.when(F.col("l_orderkey") % 2 == 0, F.to_json(F.struct(F.lit("text").alias("type"), F.concat(F.lit("p"), F.col("l_partkey")).alias("text")))).otherwise(tool)
    part = li.select(F.concat_ws(".", "l_orderkey", "l_linenumber", F.lpad(F.col("l_partkey").cast("string"), 12, "0")).alias("id"), F.col("l_orderkey").alias("message_id"), F.col("l_linenumber").cast("long").alias("time_created"), data.alias("data"))
    h = F.conv(F.substring(F.md5("text"), 1, 12), 16, 10).cast("long")
    rows = recordings.opencode(message, part)
    return rows.groupBy(F.col("path").cast("long").alias("path"), "type").agg(F.count("*").alias("n"), F.count_if(F.coalesce("is_error", F.lit(False))).alias("errors"), F.bit_xor(h).alias("texts"))


OUTPUTS = ["Chunk ID: a1\nWall time: 0.2 seconds\nProcess exited with code 2\nboom", "Process exited with code 0\nexit_code: 1", '{"exit_code":1,"output":"x"}', '{"success":true,"output":"Error: printed"}', "apply_patch verification failed: x", "plain text with error: inside", 'label\n{"chunk_id":"a","wall_time_seconds":1,"exit_code":3,"output":"z"}', 'see {"exit_code":1}']


@query("select o_orderkey, list_contains([0, 2, 4, 6], o_orderkey % 8) as failed from orders")
def codex_results(spark, d):
    out = F.get(F.array(*map(F.lit, OUTPUTS)), (F.col("o_orderkey") % 8).cast("int"))
    return read(spark, d, "orders").select("o_orderkey", recordings.codex_failed(out).alias("failed"))
