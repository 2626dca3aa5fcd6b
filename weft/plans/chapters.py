"""Queries on chapters and session summaries: orders stand for a customer's chapters, line items for calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import chapters, quality, timing
from weft.plans.analysis import STEPS_SQL, _steps
from weft.plans.base import query, read


def _chapters(spark, d):
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    q, bad = F.col("l_quantity"), F.col("l_returnflag") == "R"
    n = lambda c, name: F.count_if(c).alias(name)
    sums = li.groupBy("l_orderkey").agg(
        F.sum(F.round("l_extendedprice").cast("long")).alias("tokens"), F.array_sort(F.collect_set(F.when(q < 20, F.col("l_partkey") % 50))).alias("files"), n((q >= 20) & (q < 22), "commits"), n(q < 10, "edits"), n((q >= 10) & (q < 20), "reads"), F.count_if(q < 45).alias("calls"), n(q.between(30, 40), "commands"), n(q.between(30, 40) & ~bad, "ok_commands"),
        n(q == 44, "agents"), n(q > 45, "thoughts"), n(bad & (q < 45), "errors"), n(bad & q.between(25, 44), "retries"), n(bad & q.between(30, 44), "failed_retries"), n(bad & (q < 5), "fixes"),
    )
    outcome = chapters.outcome(F.col("errors"), F.col("retries"), F.col("fixes"), F.lit(False), F.lit(2))
    return o.join(sums, o.o_orderkey == sums.l_orderkey).withColumns({"path": F.col("o_custkey"), "idx": F.col("o_orderkey"), "n_files": F.size("files")}).withColumn("outcome", outcome)


CHAPTERS = """c as (select o_custkey as path, o_orderkey as idx, cast(sum(cast(round(l_extendedprice) as bigint)) as bigint) as tokens, list_sort(list(distinct l_partkey % 50) filter (l_quantity < 20)) as files, count(*) filter (l_quantity >= 20 and l_quantity < 22) as commits, count(*) filter (l_quantity < 10) as edits,
  count(*) filter (l_quantity >= 10 and l_quantity < 20) as reads, count(*) filter (l_quantity < 45) as calls, count(*) filter (l_quantity between 30 and 40) as commands, count(*) filter (l_quantity between 30 and 40 and l_returnflag <> 'R') as ok_commands, count(*) filter (l_quantity = 44) as agents, count(*) filter (l_quantity > 45) as thoughts,
  count(*) filter (l_returnflag = 'R' and l_quantity < 45) as errors, count(*) filter (l_returnflag = 'R' and l_quantity between 25 and 44) as retries, count(*) filter (l_returnflag = 'R' and l_quantity between 30 and 44) as failed_retries, count(*) filter (l_returnflag = 'R' and l_quantity < 5) as fixes from orders join lineitem on l_orderkey = o_orderkey group by all),
 a as (select *, coalesce(len(files), 0) as n_files, avg(tokens) over (partition by path) as av from c), h as (select *, tokens > av * 1.5 as high, tokens / av as ratio from a),
 s as (select *, cast(greatest(0, least(100, floor(100.5 - case when calls > 0 then least(40.0, errors / calls * 200) else 0 end - case when calls > 0 then least(25.0, retries / calls * 150) else 0 end - case when ratio > 2 and edits + commits + ok_commands <= 1 then least(25.0, (ratio - 1) * 10) else 0 end
   + case when fixes > 0 and errors > 0 then least(10.0, fixes / errors * 10) else 0 end))) as bigint) as score, list_filter([case when high and n_files + commits + edits + commands + agents = 0 then 'high tokens, no file changes or actions' end, case when failed_retries >= 3 and fixes = 0 then failed_retries || ' failed retries without resolution' end,
   case when thoughts > 0 and calls = 0 then 'reasoning with no tool actions' end, case when errors >= 3 and fixes = 0 then errors || ' errors, no self-correction' end, case when reads >= 6 and edits = 0 and commits = 0 and high then 'heavy reading with no edits' end], lambda x: x is not null) as reasons from h),
 e as (select *, len(reasons) > 0 or score < 40 as wasteful, case when len(reasons) > 0 or score < 40 then cast(floor(tokens * greatest(0.2, 1 - score / 100) + 0.5) as bigint) else 0 end as waste_tokens,
   case when errors = 0 and retries = 0 then 'clean' when fixes > 0 and fixes >= errors * 0.5 then 'corrected' when retries >= 3 or errors >= 3 then 'struggling' when fixes > 0 then 'corrected' when errors >= 2 then 'struggling' else 'corrected' end as outcome from s)"""


@query(f"""with {CHAPTERS} select path, idx, score, array_to_string(reasons, '; ') as reasons, wasteful, waste_tokens, case when n_files > 0 then cast(floor(tokens / n_files + 0.5) as bigint) else 0 end as tok_per_file, case when commits > 0 then cast(floor(tokens / commits + 0.5) as bigint) else 0 end as tok_per_commit,
  case when calls > 0 then cast(floor(tokens * errors / calls + 0.5) as bigint) else 0 end as error_tokens from e""")
def chapter_efficiency(spark, d):
    out = quality.efficiency(_chapters(spark, d))
    return out.select("path", "idx", "score", F.array_join("reasons", "; ").alias("reasons"), "wasteful", "waste_tokens", "tok_per_file", "tok_per_commit", "error_tokens")


@query(f"""with {CHAPTERS}, f as (select path, count(distinct file) as files from (select path, unnest(files) as file from e) group by path) select path, count(*) as chapters, count(*) filter (outcome = 'clean') as clean, count(*) filter (outcome = 'corrected') as corrected, count(*) filter (outcome = 'struggling') as struggling, cast(sum(errors) as bigint) as errors,
  cast(sum(retries) as bigint) as retries, cast(sum(fixes) as bigint) as fixes, cast(sum(commits) as bigint) as commits, count(*) filter (wasteful) as wasteful, cast(sum(waste_tokens) as bigint) as waste_tokens, coalesce(any_value(f.files), 0) as files from e left join f using (path) group by path""")
def session_overview(spark, d):
    return quality.overview(quality.efficiency(_chapters(spark, d)))


@query("""select l_returnflag || l_linestatus as tool, count(*) as total, count(*) filter (l_quantity > 40) as errors, count(*) filter (l_linenumber > 5) as retries, count(distinct l_orderkey) as chapters from lineitem group by 1""")
def tool_performance(spark, d):
    li = read(spark, d, "lineitem").select(F.lit(0).alias("path"), F.col("l_orderkey").alias("chapter"), F.concat("l_returnflag", "l_linestatus").alias("tool"), (F.col("l_quantity") > 40).alias("failed"), (F.col("l_linenumber") > 5).alias("retry"))
    return quality.tool_performance(li)


def _touches(spark, d):
    li = read(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("path"), F.col("l_orderkey").alias("chapter"), F.col("l_partkey").alias("file"), F.when(F.col("l_returnflag") == "N", "read").otherwise("edit").alias("op"), (F.col("l_returnflag") == "R").alias("failed"), F.concat(F.lit("t"), F.col("l_linenumber")).alias("tool"))


@query("""with t as (select l_suppkey as path, l_partkey as file, count(*) as touches, count(*) filter (l_returnflag = 'N') as reads, count(*) filter (l_returnflag <> 'N') as edits, count(distinct l_orderkey) as chapters from lineitem group by all) select *, cast(row_number() over (partition by path order by touches desc, file) as integer) as r from t qualify r <= 30""")
def file_hotspots(spark, d):
    return quality.file_hotspots(_touches(spark, d))


@query("""with t as (select l_suppkey as path, 't' || l_linenumber as tool, count(*) as errors from lineitem where l_returnflag = 'R' group by all) select *, cast(row_number() over (partition by path order by errors desc, tool) as integer) as r from t qualify r <= 6""")
def errors_by_tool(spark, d):
    return quality.errors_by_tool(_touches(spark, d))


@query("""with p as (select conv_id as path, turn as chapter, coalesce(text, '') as prompt from conversations where role = 'user') select path, chapter, coalesce(regexp_matches(lead(prompt) over (partition by path order by chapter), '\\b(no|wrong|idiot|revert|undo|actually|instead)\\b|not what', 'i'), false) as corrected from p""".replace("\\\\", "\\"))
def corrected_prompts(spark, d):
    p = read(spark, d, "conversations").filter("role = 'user'").select(F.col("conv_id").alias("path"), F.col("turn").alias("chapter"), F.coalesce("text", F.lit("")).alias("prompt"))
    return quality.corrected(p).select("path", "chapter", "corrected")


@query("""with b as (select user_id as path, event_id as ord, case event_type when 'click' then 'command' when 'view' then 'read' when 'error' then 'read' when 'signup' then '-' end as kind, event_type = 'error' as failed from events), n as (select *, lag(kind) over (partition by path order by ord) as last from b where kind is not null),
  g as (select path, ord, kind, failed, sum(case when last = kind then 0 else 1 end) over (partition by path order by ord) as run from n), r as (select path, run, any_value(kind) as kind, min(ord) as start, max(ord) as stop, count(*) as rows, count(*) filter (failed) as failed from g where kind <> '-' group by all)
  select r.path, r.start, r.kind, r.rows, (select count(*) from b where b.path = r.path and b.kind is null and b.ord > r.start and b.ord < r.stop) as thoughts, r.failed from r""")
def tool_groups(spark, d):
    e = read(spark, d, "events")
    block = F.when(F.col("event_type") == "purchase", "thought").when(F.col("event_type") == "signup", "user").otherwise("tool")
    tool = F.when(F.col("event_type") == "click", "Bash").when(F.col("event_type") == "view", "Read").when(F.col("event_type") == "error", "view_image")
    return quality.tool_groups(e.select(F.col("user_id").alias("path"), F.col("event_id").alias("ord"), block.alias("block"), tool.alias("tool"), (F.col("event_type") == "error").alias("failed")))


@query(f"""with {STEPS_SQL}, t as (select path, tool, count(*) as n, min(seq) as f from st where type = 'call' group by all), l as (select path, array_to_string(list(tool order by f), ',') as tools, array_to_string(list(tool || '=' || n order by tool), ',') as tool_counts from t group by path)
  select path, count(*) as n_events, min(ms) as first_ms, max(ms) as last_ms, count(*) filter (type = 'user') as chapters, count(*) filter (type = 'assistant') as turns, count(*) filter (type = 'call') as calls, count(*) filter (type = 'tool_result' and is_error) as errors, 0 as commits, count(distinct case when tool in ('Edit', 'Read') then input end) as files,
  arg_min(text, case when type = 'user' then seq end) as first_prompt, any_value(tools) as tools, any_value(tool_counts) as tool_counts from st left join l using (path) group by path""")
def session_index(spark, d):
    out = quality.session_index(_steps(spark, d))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("tool_counts")), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return out.withColumns({"tools": F.array_join("tools", ","), "tool_counts": shown})


@query("""select c_custkey as path, c_custkey % 10 as mtime, case when c_custkey % 3 = 0 then c_custkey * 2 when o.n is not null then o.n end as calls, c_custkey % 3 = 0 as from_index from customer left join (select o_custkey, count(*) as n from orders group by 1) o on o_custkey = c_custkey""")
def session_summaries(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("path"), (F.col("c_custkey") % 10).alias("mtime"))
    index = c.select("path", F.when(F.col("path") % 3 == 0, F.col("mtime")).otherwise(F.col("mtime") + 1).alias("mtime"), (F.col("path") * 2).alias("calls"))
    parsed = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.count("*").alias("calls"))
    return quality.summaries(c, index, parsed, ["calls"])


@query("""with r as (select l_suppkey as path, case when l_linenumber % 3 <> 0 then l_orderkey end as request_id, l_partkey as message_id, cast(l_quantity as bigint) as input, l_linenumber as output from lineitem), u as (select path, max(input) as input, max(output) as output from r where request_id is not null group by path, request_id, message_id union all select path, input, output from r where request_id is null)
  select path, cast(sum(input) as bigint) as input, cast(sum(output) as bigint) as output, count(*) as requests from u group by path""")
def usage_by_request(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("path"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_orderkey")).alias("request_id"), F.col("l_partkey").alias("message_id"), F.col("l_quantity").cast("long").alias("input"), F.col("l_linenumber").cast("long").alias("output"))
    return quality.usage(li)


@query("""with t as (select user_id as path, event_id as seq, cast(round(value) as bigint) as v, coalesce(lag(cast(round(value) as bigint)) over (partition by user_id order by event_id), 0) as l from events) select path, seq, case when v >= l then v - l else v end as grown from t""")
def counter_growth(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), F.round("value").cast("long").alias("v"))
    return quality.growth(e, "v").select("path", "seq", "grown")


@query("""with t as (select conv_id as path, length(coalesce(text, '')) as chars, case when conv_id % 2 = 0 then turn end as output from conversations), s as (select path, cast(sum(coalesce(output, 0)) as bigint) as reported, cast(sum(greatest(1, floor(chars / 4 + 0.5))) as bigint) as guessed from t group by path) select path, case when reported > 0 then reported else guessed end as tokens, reported = 0 as estimated from s""")
def estimated_tokens(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("path"), F.length(F.coalesce("text", F.lit(""))).alias("chars"), F.when(F.col("conv_id") % 2 == 0, F.col("turn")).alias("output"))
    return quality.estimated_tokens(c)


@query("""with f as (select source as path, text as chunk, min(doc_id) as seq from documents where text is not null group by 1, 2), b as (select *, 500000 - coalesce(sum(length(chunk)) over (partition by path order by seq rows between unbounded preceding and 1 preceding), 0) as l from f) select path, seq, md5(substring(chunk, 1, cast(l as bigint))) as h from b where l > 0""")
def budgeted_chunks(spark, d):
    docs = read(spark, d, "documents").filter("text is not null").select(F.col("source").alias("path"), F.col("doc_id").alias("seq"), F.col("text").alias("chunk"))
    return quality.within_budget(docs, 500_000).select("path", "seq", F.md5("chunk").alias("h"))


@query(f"with {STEPS_SQL} select path, seq, case type when 'user' then 1 when 'assistant' then 2 when 'call' then 2 when 'tool_result' then case when of_tool = 'Bash' then 5 else 3 end else 0 end as kind from st")
def record_kinds(spark, d):
    return _steps(spark, d).select("path", "seq", timing.record_kind(F.col("type"), F.col("of_tool")).cast("long").alias("kind"))


@query("select o_custkey, o_orderkey, o_orderpriority from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) <= 3")
def newest_of_each(spark, d):
    from weft.operators.insights import top

    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return top(o, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("""with {s} select path, count(*) as n, count(*) filter (answered = 1) as answered from (select path, tool_use_id, max(cast(type = 'tool_result' as int)) as answered from st where tool_use_id is not null group by all) group by path""".replace("{s}", STEPS_SQL))
def answered_calls(spark, d):
    w = _steps(spark, d).filter("tool_use_id is not null").groupBy("path", "tool_use_id").agg(F.max((F.col("type") == "tool_result").cast("int")).alias("answered"))
    return w.groupBy("path").agg(F.count("*").alias("n"), F.count_if(F.col("answered") == 1).alias("answered"))
