"""Queries on timing, calls and insights."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.functions import errors, money
from weft.functions.text import session_hash
from weft.operators import calls as call_ops
from weft.operators import chapters, insights, timing
from weft.plans.base import CALLS_SQL, EVENTS_SQL, calls, query, read, timed_events

GAPS = f"""{EVENTS_SQL}, g as (select *, ms - max(ms) over w as gap, last_value(case when kind <> 0 then kind end ignore nulls) over w as last_message, lag(kind) over (partition by path order by seq) as last_kind
  from ev window w as (partition by path order by seq rows between unbounded preceding and 1 preceding))"""


@query(f"""with {EVENTS_SQL} select path, count(*) as n, min(ms) as start_ms, max(ms) as end_ms, count(*) filter (kind = 1) as user_messages, count(*) filter (kind = 2) as assistant_turns,
  count(*) filter (event_type = 'error') as errors, round(sum(value), 4) as total from ev group by path""")
def session_stats(spark, d):
    ev = timed_events(spark, d)
    return ev.groupBy("path").agg(F.count("*").alias("n"), F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"), F.count_if(F.col("kind") == 1).alias("user_messages"), F.count_if(F.col("kind") == 2).alias("assistant_turns"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""with {GAPS}, t as (select *, case when gap > 0 and (gap <= 300000 or (kind = 5 and gap <= 21600000) or (kind = 2 and last_message in (3, 5) and gap <= 1800000)) then gap else 0 end as work from g),
  u as (select *, sum(work) over (partition by path order by seq rows unbounded preceding) as upto from t)
  select path, cast(sum(work) as bigint) as active_ms, cast(max(upto) filter (kind <> 0) as bigint) as at_message_ms from u group by path""")
def worked_time(spark, d):
    return timing.worked_time(timed_events(spark, d))


@query(f"""with {GAPS}, t as (select *, (kind = 5 and gap <= 21600000) or (kind = 2 and last_kind in (3, 5) and gap <= 1800000) as waited from g where gap >= 300000)
  select path, count(*) filter (waited) as stalls, cast(sum(case when waited then gap else 0 end) as bigint) as stall_ms, coalesce(max(gap) filter (waited), 0) as longest_stall_ms,
  cast(sum(case when waited then 0 else gap end) as bigint) as idle_ms from t group by path""")
def stalls_and_idle(spark, d):
    return timing.stalls(timed_events(spark, d))


@query(f"""with {EVENTS_SQL}, c as (select path, seq, ms, case when coalesce(ms - lag(ms) over (partition by path order by ms, seq), 0) >= 120000 then 1 else 0 end as cut from ev),
  s as (select *, cast(sum(cut) over (partition by path order by ms, seq rows unbounded preceding) as bigint) as segment from c)
  select path, segment, min(ms) as start_ms, max(ms) as end_ms, count(*) as n from s group by all""")
def sessionized_segments(spark, d):
    return timing.segments(timed_events(spark, d))


@query(f"""with {EVENTS_SQL}, s as (select path, min(ms) as f, max(ms) as t from ev group by path)
  select path, cast(case when t > f then least(19, floor((ms - f) / ((t - f) / 20.0))) else 0 end as integer) as bucket, count(*) as n from ev join s using (path) group by all""")
def activity_density(spark, d):
    return timing.density(timed_events(spark, d), buckets=20)


@query(f"""with {CALLS_SQL}, t as (select *, last_value(case when failed then ord end ignore nulls) over (partition by path, sig order by ord rows between unbounded preceding and 1 preceding) as l from calls)
  select path, count(*) filter (ord - l <= 20) as retries from t group by path""")
def call_retries(spark, d):
    return call_ops.retries(calls(spark, d))


@query(f"""with {CALLS_SQL}, t as (select path, tool, count(*) over (partition by path, tool order by ord range between 11 preceding and current row) as seen from calls), m as (select path, tool, max(seen) as seen from t group by all)
  select path, count(*) filter (seen >= 3) as loops, cast(sum(case when seen >= 3 then seen else 0 end) as bigint) as loop_calls from m group by path""")
def call_loops(spark, d):
    return call_ops.loops(calls(spark, d).withColumn("sig", F.col("tool")))


@query(f"""with {CALLS_SQL}, t as (select tool, lead(tool) over (partition by path order by ord) as next_tool from calls) select tool, next_tool, count(*) as n from t where next_tool is not null group by all""")
def tool_transitions(spark, d):
    return call_ops.transitions(calls(spark, d), ["path"])


@query(f"""with {CALLS_SQL}, t as (select path, ord, failed, row_number() over (partition by path order by ord) - sum(cast(failed as int)) over (partition by path order by ord rows unbounded preceding) as island from calls)
  select path, min(ord) as start_ord, count(*) as length from t where failed group by path, island having count(*) >= 2""")
def error_streaks(spark, d):
    return call_ops.error_streaks(calls(spark, d))


@query(f"""with {CALLS_SQL}, t as (select path, failed and (coalesce(lead(target, 1) over w = target and not lead(failed, 1) over w, false) or coalesce(lead(target, 2) over w = target and not lead(failed, 2) over w, false)
  or coalesce(lead(target, 3) over w = target and not lead(failed, 3) over w, false)) as fixed from calls window w as (partition by path order by ord)) select path, count(*) filter (fixed) as corrections from t group by path""")
def self_corrections(spark, d):
    return call_ops.self_corrections(calls(spark, d))


@query()
def chapter_retry_groups(spark, d):
    """Clicks begin chapters; what an event is about is the tens of its property."""
    c = chapters.with_chapters(calls(spark, d), "path", "ord", F.col("tool") == "click")
    c = c.withColumns({"target": F.substring("target", 1, 7), "ord": F.row_number().over(Window.partitionBy("path", "chapter").orderBy("seq"))})
    return chapters.retry_groups(c)


@query("""with t as (select event_type as facet_type, cast(extract(hour from ts) as bigint) as hour from events), p as (select 'event_type' as facet, facet_type as value from t union all select 'hour', cast(hour as varchar) from t),
  n as (select facet, value, count(*) as n from p group by all) select facet, value, n, cast(row_number() over (partition by facet order by n desc, value) as integer) as r from n qualify r <= 6""")
def facet_counts(spark, d):
    ev = read(spark, d, "events").select("event_type", F.hour("ts").alias("hour"))
    return insights.facets(ev, ["event_type", "hour"])


@query("""with s as (select user_id, any_value(event_type) as x, count(*) as calls, count(*) filter (event_type = 'error') as errors, user_id % 7 as host, user_id % 3 as area from events group by user_id),
  u as (select 'host' as grouping, cast(host as varchar) as value, calls, errors from s union all select 'area', cast(area as varchar), calls, errors from s)
  select grouping, value, count(*) as sessions, count(*) filter (errors > 0) as error_sessions, cast(sum(calls) as bigint) as calls, cast(sum(errors) as bigint) as errors, round(sum(errors) / sum(calls), 9) as rate from u group by grouping, value""")
def error_breakdown(spark, d):
    s = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors")).withColumns({"host": F.col("user_id") % 7, "area": F.col("user_id") % 3})
    return insights.breakdown(s, ["host", "area"]).withColumn("rate", F.round("rate", 9))


@query("""select event_type, quantile_disc(value, 0.5) as q50, quantile_disc(value, 0.9) as q90 from events where value > 0 group by event_type""")
def nearest_rank_quantiles(spark, d):
    return insights.nearest_rank(read(spark, d, "events"), "value", ["event_type"], [0.5, 0.9])


@query("""with l(label) as (values ('<10'), ('10-50'), ('50-100'), ('100-200'), ('>=200')), n as (select case when value < 10 then '<10' when value < 50 then '10-50' when value < 100 then '50-100' when value < 200 then '100-200' else '>=200' end as label, count(*) as n
  from events where value is not null group by 1) select label, coalesce(n, 0) as n from l left join n using (label)""")
def fixed_histogram(spark, d):
    return insights.histogram(read(spark, d, "events"), "value", [10, 50, 100, 200], ["<10", "10-50", "50-100", "100-200", ">=200"])


@query("""select event_type, event_id, value, cast(row_number() over (partition by event_type order by value desc, event_id) as integer) as r from events qualify r <= 5""")
def top_examples(spark, d):
    return insights.top(read(spark, d, "events").select("event_type", "event_id", "value"), ["event_type"], [F.desc("value"), F.asc("event_id")], 5)


@query("""with c as (select user_id, event_type as tool, count(*) as n from events where user_id in (1, 2) group by all), a as (select tool, n from c where user_id = 1), b as (select tool, n from c where user_id = 2)
  select tool, coalesce(a.n, 0) as n_left, coalesce(b.n, 0) as n_right, n_right - n_left as delta, abs(n_right - n_left) < 0.05 * greatest(n_left, n_right) as noise from a full join b using (tool)""")
def compare_two_sessions(spark, d):
    counts = read(spark, d, "events").groupBy("user_id", F.col("event_type").alias("tool")).agg(F.count("*").alias("n"))
    return insights.compare(counts, "user_id", 1, 2)


@query("""with s as (select o_orderkey as path, cast(o_totalprice as bigint) as input, cast(count(*) as bigint) as chapters, cast(sum(l_quantity) as bigint) as calls, count(*) filter (l_returnflag = 'R') as errors
  from orders join lineitem on l_orderkey = o_orderkey group by all), p as (select *, input // 2 as cached from s), g as (select *, greatest(0, 100 - errors / calls * 250) as e, errors / chapters as each, input + cached as total from p),
  k as (select path, cast(least(100, greatest(0, floor(e * 0.35 + (case when each = 0 then 100 when each < 1 then 80 when each < 2 then 50 else 20 end) * 0.2 + 10 + (case when errors = 0 then 100 else 75 end) * 0.15
  + (case when total < 10000 then 75 else least(100, cached / total * 125) end) * 0.2 + 0.5))) as integer) as score from g)
  select path, score, case when score >= 90 then 'A' when score >= 80 then 'B' when score >= 70 then 'C' when score >= 60 then 'D' else 'F' end as letter from k""")
def session_grades(spark, d):
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    s = li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("o_orderkey").alias("path"), F.col("o_totalprice")).agg(F.count("*").alias("chapters"), F.round(F.sum("l_quantity")).cast("long").alias("calls"), F.count_if(F.col("l_returnflag") == "R").alias("errors"))
    s = s.withColumn("input", F.round("o_totalprice").cast("long")).withColumn("cached", F.expr("input div 2"))
    score = money.grade_score(*(F.col(c) for c in ("chapters", "errors", "calls", "input", "cached")))
    return s.select("path", score.alias("score")).withColumn("letter", money.grade_letter(F.lit(1), F.col("score")))


@query("""select c_mktsegment as model, count(*) as n, round(sum((greatest(0, c_custkey * 10 - c_custkey * 4 - c_custkey) * 3.0 + c_custkey * 4 * 0.3 + c_custkey * 2 * 15.0 + c_custkey * 3.75) / 1e6), 6) as cost from customer group by 1""")
def model_costs(spark, d):
    k = F.col("c_custkey")
    return read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("model")).agg(F.count("*").alias("n"), F.round(F.sum(money.cost(F.col("c_mktsegment"), k * 10, k * 2, k * 4, k, F.lit(0))), 6).alias("cost"))


@query("with t as (select 'documents' as kind, coalesce(text, '') as text from documents union all select 'conversations', coalesce(text, '') from conversations union all select 'pages', coalesce(html, '') from pages) select kind, " + errors.first_class_sql("text") + " as class, count(*) as n from t group by all")
def error_classes(spark, d):
    """All texts of the tables, as if each were what a failed call returned."""
    texts = [read(spark, d, t).select(F.lit(t).alias("kind"), F.col(c).alias("text")) for t, c in (("documents", "text"), ("conversations", "text"), ("pages", "html"))]
    return texts[0].unionByName(texts[1]).unionByName(texts[2]).groupBy("kind", errors.error_class(F.col("text")).alias("class")).agg(F.count("*").alias("n"))


MADE = ["Error: ENOENT: no such file, open '/", "Exit code 124 ", "fatal: not a git repository ", "ValueError: 3\nTraceback (most recent call last)", "bash: foo: command not found ", "3 failed, 2 passed in ", "HTTP 503 from ", "Exit code 2 after ", "all good with ", "No module named ", "Permission denied ", "SyntaxError: invalid ", "0→ a line of ", "Exit code 0 "]
MADE_CLASSES = ["missing-path", "timeout", "git", "python-exception", "command-not-found", "test-failure", "network-auth", "nonzero-exit", "other", "missing-dep", "permission", "syntax", "other", "nonzero-exit"]


@query("with k as (select o_orderkey, o_orderkey % 14 as k from orders) select o_orderkey, [" + ", ".join(f"'{c}'" for c in MADE_CLASSES) + "][k + 1] as class, k >= 12 as suspect from k")
def made_errors(spark, d):
    """Results made from orders: what each is, is known."""
    made = F.concat(F.get(F.array(*map(F.lit, MADE)), (F.col("o_orderkey") % 14).cast("int")), "o_orderpriority")
    return read(spark, d, "orders").select("o_orderkey", errors.error_class(made).alias("class"), errors.is_suspect(made).alias("suspect"))


@query("select c_custkey, substring(sha256(c_name), 1, 8) as hash from customer")
def session_hashes(spark, d):
    return read(spark, d, "customer").select("c_custkey", session_hash(F.col("c_name")).alias("hash"))


@query("""with t as (select o_custkey, o_orderkey, o_totalprice, sum(o_totalprice) over (partition by o_custkey) as s, floor(100 * o_totalprice / sum(o_totalprice) over (partition by o_custkey)) as f from orders),
  u as (select *, 100 - sum(f) over (partition by o_custkey) as rest, row_number() over (partition by o_custkey order by 100 * o_totalprice / s - f desc, o_orderkey) as r from t)
  select o_custkey, o_orderkey, cast(f + case when r <= rest then 1 else 0 end as bigint) as share from u""")
def apportioned_tokens(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return chapters.longest_remainder(o, "o_custkey", "o_totalprice", F.lit(100), "o_orderkey").select("o_custkey", "o_orderkey", F.col("share").cast("long").alias("share"))


@query("""with r as (select l_orderkey, l_partkey, max(l_quantity) as q, max(l_extendedprice) as p from lineitem group by all) select l_orderkey, count(*) as requests, cast(sum(q) as bigint) as tokens, round(sum(p), 2) as billed from r group by l_orderkey""")
def deduplicated_usage(spark, d):
    r = read(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("q"), F.max("l_extendedprice").alias("p"))
    return r.groupBy("l_orderkey").agg(F.count("*").alias("requests"), F.sum("q").cast("long").alias("tokens"), F.round(F.sum("p"), 2).alias("billed"))


@query(f"""with {EVENTS_SQL}, t as (select path, seq, cast(round(value) as bigint) as v from ev), g as (select path, greatest(v - coalesce(lag(v) over (partition by path order by seq), 0), 0) as growth, last_value(v) over (partition by path order by seq rows between unbounded preceding and unbounded following) as final from t)
  select path, cast(sum(growth) as bigint) as grown, any_value(final) as final from g group by path""")
def cumulative_growth(spark, d):
    w = Window.partitionBy("path").orderBy("seq")
    v = timed_events(spark, d).select("path", "seq", F.round("value").cast("long").alias("v"))
    return v.withColumn("growth", F.greatest(F.col("v") - F.coalesce(F.lag("v").over(w), F.lit(0)), F.lit(0))).groupBy("path").agg(F.sum("growth").alias("grown"), F.max_by("v", "seq").alias("final"))


@query(f"""with {CALLS_SQL}, g as (select path, tool, ord, count(*) over (partition by path, tool) as n, min(ord) over (partition by path, tool) as f from calls) select path, tool as area, n as hits from g qualify row_number() over (partition by path order by n desc, f, ord) = 1""")
def dominant_area(spark, d):
    g = calls(spark, d).groupBy("path", "tool").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return insights.top(g, ["path"], [F.desc("n"), F.asc("first")], 1).select("path", F.col("tool").alias("area"), F.col("n").alias("hits"))
