"""Queries on analysed sessions: customers stand for sessions, their line items for calls, returned ones for errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import analysis, insights, search
from weft.plans.base import EVENTS_SQL, query, read, timed_events


def _facts(spark, d):
    o, li, c = read(spark, d, "orders"), read(spark, d, "lineitem"), read(spark, d, "customer")
    bad, many = F.col("l_returnflag") == "R", F.col("l_quantity") > 45
    line = li.join(o, li.l_orderkey == o.o_orderkey).select("o_custkey", "o_orderpriority", "o_orderstatus", "l_returnflag", "l_linenumber", F.col("l_quantity").cast("long").alias("l_quantity"), F.round("l_extendedprice").cast("long").alias("tokens"))
    sums = line.groupBy("o_custkey").agg(
        F.count("*").alias("calls"), F.count_if(bad).alias("errors"), F.count_if((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1)).alias("suspect"), F.count_if(bad & many).alias("retries"), F.count_if(F.col("l_quantity") == 49).alias("loops"),
        F.sum(F.when(F.col("l_quantity") == 49, F.col("l_linenumber")).otherwise(0)).cast("long").alias("loop_calls"), F.count_if(F.col("l_quantity") == 50).alias("stalls"), F.sum(F.when(F.col("l_quantity") == 50, F.col("tokens")).otherwise(0)).alias("stall_ms"),
        F.max(F.when(F.col("l_quantity") == 50, F.col("tokens"))).alias("longest_stall_ms"), F.sum("tokens").alias("tokens"),
    )
    classes = line.filter(bad).groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n")).groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("classes"))
    trap = line.filter(bad & many).groupBy("o_custkey", "o_orderstatus").agg(F.struct(F.count("*").alias("n"), F.sum("tokens").alias("ms")).alias("t")).groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "t"))).alias("traps"))
    rows = c.join(sums, c.c_custkey == sums.o_custkey).join(classes, "o_custkey", "left").join(trap, "o_custkey", "left")
    k = F.col("c_custkey")
    return rows.withColumns({"path": k.cast("string"), "ord": k, "source": F.col("c_mktsegment"), "host": F.when(F.col("c_nationkey") % 5 != 0, F.concat(F.lit("h"), F.col("c_nationkey") % 5)), "area": F.when(k % 4 != 0, F.concat(F.lit("a"), k % 11)), "analyzed": k % 7 != 0, "active_ms": F.col("calls") * 1000, "cost": F.col("tokens") / 1e6})


FACTS = """line as (select o_custkey, o_orderpriority, o_orderstatus, l_returnflag, l_linenumber, cast(l_quantity as bigint) as l_quantity, cast(round(l_extendedprice) as bigint) as tokens from lineitem join orders on l_orderkey = o_orderkey),
 facts as (select cast(c_custkey as varchar) as path, c_custkey as ord, c_mktsegment as source, case when c_nationkey % 5 <> 0 then 'h' || c_nationkey % 5 end as host, case when c_custkey % 4 <> 0 then 'a' || c_custkey % 11 end as area, c_custkey % 7 <> 0 as analyzed, calls * 1000 as active_ms, tokens / 1e6 as cost, s.* from customer join
  (select o_custkey, count(*) as calls, count(*) filter (l_returnflag = 'R') as errors, count(*) filter (l_returnflag = 'A' and l_linenumber = 1) as suspect, count(*) filter (l_returnflag = 'R' and l_quantity > 45) as retries, count(*) filter (l_quantity = 49) as loops,
   cast(coalesce(sum(l_linenumber) filter (l_quantity = 49), 0) as bigint) as loop_calls, count(*) filter (l_quantity = 50) as stalls, cast(coalesce(sum(tokens) filter (l_quantity = 50), 0) as bigint) as stall_ms, max(tokens) filter (l_quantity = 50) as longest_stall_ms, cast(sum(tokens) as bigint) as tokens from line group by 1) s on c_custkey = o_custkey),
 done as (select * from facts where analyzed), cl as (select path, ord, o_orderpriority as class, count(*) as n from line join done using (o_custkey) where l_returnflag = 'R' group by all)"""
LIST5 = "array_to_string(list(path order by r)[1:5], ',')"


@query(f"""with {FACTS} select count(*) as sessions, count(*) filter (analyzed) as analyzed, count(*) filter (not analyzed) as pending, count(distinct coalesce(host, 'local')) filter (analyzed) as hosts, cast(sum(calls) filter (analyzed) as bigint) as calls, cast(sum(errors) filter (analyzed) as bigint) as errors,
  cast(sum(suspect) filter (analyzed) as bigint) as suspect, cast(sum(tokens) filter (analyzed) as bigint) as tokens, round(sum(cost) filter (analyzed), 4) as cost, count(*) filter (analyzed and errors > 0) as error_sessions, cast(sum(active_ms) as bigint) as active_ms, round(sum(errors) filter (analyzed) / sum(calls) filter (analyzed), 9) as error_rate from facts""")
def insight_totals(spark, d):
    return analysis.totals(_facts(spark, d)).withColumns({"cost": F.round("cost", 4), "error_rate": F.round("error_rate", 9)})


@query(f"""with {FACTS}, r as (select *, row_number() over (partition by class order by n desc, ord) as r from cl) select class, cast(sum(n) as bigint) as n, count(*) as sessions, {LIST5} as examples, round(sum(n) / (select sum(errors) from done), 9) as share from r group by class""")
def insight_error_classes(spark, d):
    return analysis.class_report(_facts(spark, d)).withColumns({"share": F.round("share", 9), "examples": F.array_join("examples", ",")})


@query(f"""with {FACTS}, g as (select 'source' as grouping, source as value, done.* from done union all select 'area', area, done.* from done where area is not null union all select 'host', coalesce(host, 'local'), done.* from done),
  s as (select grouping, value, count(*) as sessions, count(*) filter (errors > 0) as error_sessions, cast(sum(calls) as bigint) as calls, cast(sum(errors) as bigint) as errors from g group by 1, 2 qualify row_number() over (partition by grouping order by sum(calls) desc, value) <= case grouping when 'area' then 8 else 12 end),
  c as (select grouping, value, class, sum(n) as n from g join cl using (path) group by all), t as (select *, row_number() over (partition by grouping, value order by n desc, class) as r from c), b as (select grouping, value, array_to_string(list(class order by r), ',') as top_classes from t where r <= 3 group by all),
  w as (select grouping, value, path, row_number() over (partition by grouping, value order by errors desc, ord) as r from g where errors > 0), v as (select grouping, value, {LIST5} as worst from w group by 1, 2)
  select s.*, round(errors / calls, 9) as rate, top_classes, worst from s left join b using (grouping, value) left join v using (grouping, value)""")
def insight_groups(spark, d):
    out = analysis.group_report(_facts(spark, d), {"source": 12, "area": 8, "host": 12}).drop("r")
    return out.withColumns({"rate": F.round("rate", 9), "top_classes": F.array_join("top_classes", ","), "worst": F.array_join("worst", ",")})


@query(f"""with {FACTS}, t as (select path, ord, o_orderstatus as trap, count(*) as n, sum(line.tokens) as ms from line join done using (o_custkey) where l_returnflag = 'R' and l_quantity > 45 group by all), r as (select *, row_number() over (partition by trap order by n desc, ord) as r from t)
  select trap, count(*) as sessions, cast(sum(n) as bigint) as events, cast(sum(ms) as bigint) as ms, {LIST5} as examples from r group by trap""")
def insight_traps(spark, d):
    return analysis.trap_report(_facts(spark, d)).withColumn("examples", F.array_join("examples", ","))


@query(f"""with {FACTS}, l as (select path, 0 as k, row_number() over (order by loop_calls desc, ord) as r from done where loops > 0), t as (select path, 1 as k, row_number() over (order by retries desc, ord) as r from done where retries > 0),
  u as (select path, min(k * 10 + r) as r from (select * from l where r <= 5 union all select * from t where r <= 5) group by path)
  select cast(sum(retries) as bigint) as retries, count(*) filter (retries > 0) as retry_sessions, cast(sum(loops) as bigint) as loops, cast(sum(loop_calls) as bigint) as loop_calls, count(*) filter (loops > 0) as loop_sessions, (select {LIST5} from u) as examples from done""")
def insight_repeats(spark, d):
    return analysis.repeat_report(_facts(spark, d)).withColumn("examples", F.array_join("examples", ","))


@query(f"""with {FACTS}, r as (select *, row_number() over (order by longest_stall_ms desc, ord) as r from done where stalls > 0) select cast(sum(stalls) as bigint) as stalls, count(*) as sessions, cast(sum(stall_ms) as bigint) as ms, {LIST5} as examples from r having count(*) > 0""")
def insight_stalls(spark, d):
    return analysis.stall_report(_facts(spark, d)).withColumn("examples", F.array_join("examples", ","))


@query(f"with {FACTS} select path, tokens, errors, round(cost, 6) as cost from done where cost > 0 order by facts.cost desc, ord limit 10".replace("order by facts.cost", "order by done.cost"))
def most_expensive_sessions(spark, d):
    return analysis.most_expensive(_facts(spark, d)).select("path", "tokens", "errors", F.round("cost", 6).alias("cost"))


# Events as the steps of a session: views call a tool, errors and purchases answer, clicks are prompts, signups are text.
COMMANDS = ["cd /home/me/worktrees/b/repo && pytest -q", "gh run watch 7; sleep 2m", "cd /tmp && npm test", "git -C /home/me/worktrees/c/repo status", "ls"]
STEPS_SQL = EVENTS_SQL + ", s as (select path, seq, ms, case event_type when 'view' then 'call' when 'click' then 'user' when 'signup' then 'assistant' else 'tool_result' end as type, case when event_type <> 'click' and event_type <> 'signup' then cast(seq // 4 % 9 as varchar) end as tool_use_id, seq % 3 as t, [" + ", ".join(f"'{c}'" for c in COMMANDS) + """][seq % 5 + 1] as command, event_type = 'error' as is_error, value from ev),
  st as (select path, seq, ms, type, tool_use_id, is_error, case when type = 'call' then case t when 0 then 'Bash' when 1 then 'Edit' else 'Read' end end as tool, case when type = 'call' then case t when 0 then command when 1 then '/home/me/worktrees/b/repo/x.py' else '/home/me/worktrees/a/repo/src/' || seq % 3 || '/y/z.py' end end as input,
   case when is_error then case t when 0 then 'fatal: not a git repository' when 1 then 'Command timed out' else 'Exit code 0' end when type = 'assistant' then 'said ' || seq else 'fine' end as text, ms - max(ms) over w as gap, lag(type) over (partition by path order by seq) as last_type,
   case when type = 'tool_result' then last_value(case when type = 'call' then case t when 0 then 'Bash' when 1 then 'Edit' else 'Read' end end ignore nulls) over (partition by path, tool_use_id order by seq rows between unbounded preceding and 1 preceding) end as of_tool,
   case when type = 'tool_result' then last_value(case when type = 'call' then case t when 0 then command when 1 then '/home/me/worktrees/b/repo/x.py' else '/home/me/worktrees/a/repo/src/' || seq % 3 || '/y/z.py' end end ignore nulls) over (partition by path, tool_use_id order by seq rows between unbounded preceding and 1 preceding) end as of_input
   from s window w as (partition by path order by seq rows between unbounded preceding and 1 preceding))"""
CWD = "/home/me/worktrees/a/repo"


def _steps(spark, d):
    k = F.col("seq")
    type_ = F.when(F.col("event_type") == "view", "call").when(F.col("event_type") == "click", "user").when(F.col("event_type") == "signup", "assistant").otherwise("tool_result")
    ev = timed_events(spark, d).withColumn("type", type_)
    call, t = F.col("type") == "call", k % 3
    tool = F.when(call, F.when(t == 0, "Bash").when(t == 1, "Edit").otherwise("Read"))
    given = F.when(call, F.when(t == 0, F.get(F.array(*map(F.lit, COMMANDS)), (k % 5).cast("int"))).when(t == 1, "/home/me/worktrees/b/repo/x.py").otherwise(F.concat(F.lit("/home/me/worktrees/a/repo/src/"), k % 3, F.lit("/y/z.py"))))
    failed = F.col("event_type") == "error"
    said = F.when(failed, F.when(t == 0, "fatal: not a git repository").when(t == 1, "Command timed out").otherwise("Exit code 0")).when(F.col("type") == "assistant", F.concat(F.lit("said "), k)).otherwise("fine")
    id_ = F.when(F.col("type").isin("call", "tool_result"), (F.expr("seq div 4") % 9).cast("string"))
    return analysis.steps(ev.select("path", "seq", "ms", "type", id_.alias("tool_use_id"), tool.alias("tool"), given.alias("input"), said.alias("text"), failed.alias("is_error")))


@query(f"""with {STEPS_SQL}, g as (select *, type = 'tool_result' and coalesce(of_tool = 'Bash', false) and gap <= 21600000 as by_tool, type = 'assistant' and coalesce(last_type = 'tool_result', false) and gap <= 1800000 as by_model from st where gap >= 300000),
  w as (select *, by_tool or by_model as waited, case when by_tool then of_tool || ': ' || of_input else 'a model turn' end as after from g)
  select path, count(*) filter (waited) as stalls, cast(coalesce(sum(gap) filter (waited), 0) as bigint) as stall_ms, cast(coalesce(sum(gap) filter (not waited), 0) as bigint) as idle_ms, max(gap) filter (waited) as longest_ms, arg_max(after, gap) filter (waited) as longest_after from w group by path""")
def session_waits(spark, d):
    return analysis.waits(_steps(spark, d))


@query(f"""with {STEPS_SQL}, x as (select *, case when type = 'tool_result' and of_tool = 'Bash' and gap between 300000 and 21600000 then gap else 0 end as stalled, is_error and text <> 'Exit code 0' as failed from st),
  y as (select path, seq, 'wrong-folder' as trap, cast(coalesce(failed and (of_tool = 'Bash' or of_tool is null) and text like '%not a git%', false) as int) as n, 0 as ms, 0 as writes, 0.0 as sleep_sec, text as example from x
   union all select path, seq, 'path-bleed', case when tool = 'Edit' then 1 when tool = 'Bash' and input like '%/worktrees/%' then 1 else 0 end, 0, case when tool = 'Edit' then 1 else 0 end, 0.0, case when tool = 'Edit' then 'Edit ' || input else input end from x
   union all select path, seq, 'test-hang', cast(coalesce(hung, false) as int), case when hung then stalled else 0 end, 0, 0.0, of_input from (select *, type = 'tool_result' and of_tool = 'Bash' and (of_input like '%pytest%' or of_input like '%npm test%') and (stalled >= 600000 or (failed and text like '%timed out%')) as hung from x)
   union all select path, seq, 'ci-wait', case when tool = 'Bash' and input like 'gh run watch%' then 1 else 0 end, case when of_tool = 'Bash' and of_input like 'gh run watch%' then stalled else 0 end, 0, case when tool = 'Bash' and input like 'gh run watch%' then 120.0 else 0.0 end, input from x)
  select path, trap, cast(sum(n) as bigint) as n, cast(sum(ms) as bigint) as ms, cast(sum(writes) as bigint) as writes, cast(sum(sleep_sec) as double) as sleep_sec, arg_min(example, case when n > 0 then seq end) as example from y where n > 0 or ms > 0 group by all""")
def session_traps(spark, d):
    return analysis.traps(_steps(spark, d), F.lit(CWD))


@query(f"with {STEPS_SQL}, a as (select path, seq, 'src/' || seq % 3 as area from st where tool = 'Read'), c as (select path, area, count(*) as hits, min(seq) as f from a group by all) select path, area, hits from c qualify row_number() over (partition by path order by hits desc, f) = 1")
def session_areas(spark, d):
    return analysis.areas(_steps(spark, d), F.lit(CWD))


@query(f"""with {STEPS_SQL}, n as (select *, coalesce(max(cast(type = 'user' as int)) over (partition by path order by seq rows between 1 following and unbounded following), 0) as later from st), k as (select *, max(cast(type = 'tool_result' as int)) over (partition by path, tool_use_id) as answered from n where later = 0),
  u as (select path, seq, 1 as o, tool || ' ' || input as line from k where type = 'call' and answered = 0 union all select path, seq, 0, text from k where type = 'assistant') select path, arg_max(line, o * 1000000000000 + seq) as line from u group by path""")
def current_activity(spark, d):
    return analysis.current_activity(_steps(spark, d))


@query(f"""with {STEPS_SQL}, t as (select path, count(ms) as timed, min(ms) as first_ms, max(ms) as last_ms, cast(coalesce(sum(gap) filter (gap >= 3600000), 0) as bigint) as idle from st group by path)
  select path, greatest(0, least(case when timed >= 2 then last_ms - first_ms else 0 end, case when path % 2 = 0 then 86400000 else last_ms - first_ms end) - idle) as active from t""")
def active_durations(spark, d):
    t = _steps(spark, d).groupBy("path").agg(F.count("ms").alias("timed"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.sum(F.when(F.col("gap") >= 3_600_000, F.col("gap"))).alias("idle"))
    end = F.when(F.col("path") % 2 == 0, F.col("first_ms") + 86_400_000)
    return t.select("path", analysis.active_ms(F.col("first_ms"), F.col("last_ms"), F.col("timed"), F.lit(None).cast("long"), end, F.col("idle")).alias("active"))


@query(f"""with {FACTS}, f as (select *, case when errors * 10 < calls then 'A' when errors * 4 < calls then 'B' end as grade from facts), e as (select 'sessions' as name, null as value, 1.0 as n from f union all select 'error_sessions', null, cast(errors > 0 as int) from f union all select 'tokens', null, tokens from f union all select 'errors', null, errors from f
  union all select 'source', source, 1 from f union all select 'host', coalesce(host, 'local'), 1 from f union all select 'grade', grade, 1 from f where grade is not null union all select 'tools', unnest(['Bash', source]), 1 from f) select name, value, cast(sum(n) as double) as n from e group by all""")
def global_stats(spark, d):
    rows = _facts(spark, d).withColumns({"host": F.coalesce("host", F.lit("local")), "grade": F.when(F.col("errors") * 10 < F.col("calls"), "A").when(F.col("errors") * 4 < F.col("calls"), "B"), "tools": F.array(F.lit("Bash"), "source")})
    return insights.global_stats(rows, ["tokens", "errors"], ["source", "host", "grade"], ["tools"])


@query("select c_custkey as path, c_custkey % 10 as mtime from customer where c_custkey % 4 = 1 or c_custkey % 3 = 2")
def sessions_to_index(spark, d):
    """A fourth has changed since it was indexed, a third isn't in the search index."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("path"), (F.col("c_custkey") % 10).alias("mtime"))
    index = c.withColumn("mtime", F.when(F.col("path") % 4 == 1, -1).otherwise(F.col("mtime")))
    return search.unindexed(c, index, c.filter("path % 3 <> 2"))


@query("""with h as (select n_name as host from nation where n_nationkey < 15 union select n_name from nation where n_nationkey % 2 = 0 union select n_name from customer join nation on n_nationkey = c_nationkey where c_custkey % 3 = 0), c as (select n_name as host, count(*) as sessions from customer join nation on n_nationkey = c_nationkey group by 1)
  select h.host, coalesce(sessions, 0) as sessions, n_nationkey < 15 as configured, case when n_nationkey % 2 = 0 then n_nationkey % 4 end as failures from h left join c using (host) join nation on n_name = h.host""")
def known_hosts(spark, d):
    """Hosts that are configured, were pulled or have imported sessions, with their sessions and failures."""
    n, c = read(spark, d, "nation"), read(spark, d, "customer")
    name = n.select(F.col("n_name").alias("host"), "n_nationkey")
    sessions = c.join(F.broadcast(name), F.col("c_nationkey") == F.col("n_nationkey"))
    configured = name.filter("n_nationkey < 15").select("host", F.lit(True).alias("configured"))
    pulled = name.filter("n_nationkey % 2 = 0").select("host", (F.col("n_nationkey") % 4).alias("failures"))
    imported = sessions.filter("c_custkey % 3 = 0").select("host")
    hosts = configured.select("host").union(pulled.select("host")).union(imported).distinct()
    counts = sessions.groupBy("host").agg(F.count("*").alias("sessions"))
    return hosts.join(counts, "host", "left").join(configured, "host", "left").join(pulled, "host", "left").select("host", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("configured", F.lit(False)).alias("configured"), "failures")
