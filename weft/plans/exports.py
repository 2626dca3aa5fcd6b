"""Queries on exports, redaction, filters by time, and rows that are put right."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import redact
from weft.operators import exports, filters
from weft.plans.analysis import STEPS_SQL, _steps
from weft.plans.base import query, read
from weft.streaming import live


def _events(spark, d) -> DataFrame:
    """Steps as events: a call is an assistant turn with one call; every eleventh result answers no call."""
    s, call = _steps(spark, d), F.col("type") == "call"
    calls = F.when(call, F.array(F.struct(F.col("tool_use_id").alias("id"), F.col("tool").alias("name"), F.to_json(F.struct(F.col("input").alias("command"))).alias("input"))))
    id_ = F.when((F.col("type") == "tool_result") & (F.col("seq") % 11 != 0), F.col("tool_use_id"))
    return s.select("path", "seq", F.when(call, "assistant").otherwise(F.col("type")).alias("type"), F.when(call, "").otherwise(F.col("text")).alias("text"), calls.alias("tool_calls"), id_.alias("tool_use_id"), "is_error")


MESSAGES = STEPS_SQL + """, res as (select distinct path, tool_use_id from st where type = 'tool_result' and seq % 11 <> 0), opened as (select st.*, type = 'call' and r.path is null as open from st left join res r on r.path = st.path and r.tool_use_id = st.tool_use_id and st.type = 'call'),
 b as (select path, seq, 0 as sub, 'user' as role, text as shown from opened where type = 'user' union all select path, seq, 0, 'assistant', case when type = 'call' then tool else text end from opened where type in ('assistant', 'call') union all select path, seq, 1, 'user', '(no output recorded)' from opened where open
  union all select path, seq, 0, 'user', case when seq % 11 = 0 then '[session error] ' || text else text end from opened where type = 'tool_result')"""


@query(f"""with {MESSAGES}, f as (select *, case when role = lag(role) over w and not (role = 'assistant') then 0 else 1 end as flip from b window w as (partition by path order by seq, sub)), i as (select *, sum(flip) over (partition by path order by seq, sub rows unbounded preceding) as message from f)
  select path, cast(message as bigint) as message, role, cast(count(*) as integer) as blocks, count(*) filter (shown = '(no output recorded)') as stubs, cast(sum(length(shown)) as bigint) as chars from i group by all""")
def anthropic_export(spark, d):
    out = exports.anthropic_messages(_events(spark, d))
    shown = F.from_json("content", "array<struct<type:string,text:string,name:string,content:string>>")
    part = F.transform(shown, lambda x: F.coalesce(x["text"], x["name"], x["content"], F.lit("")))
    counts = F.size(F.filter(part, lambda x: x == exports.NO_OUTPUT))
    return out.select("path", "message", "role", "blocks", counts.cast("long").alias("stubs"), F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query(f"""with {MESSAGES}, m as (select path, seq, sub, case when sub = 1 then 'tool' when role = 'assistant' then 'assistant' when seq in (select seq from st where type = 'tool_result' and seq % 11 <> 0) then 'tool' else 'user' end as role, shown from b)
  select path, cast(row_number() over (partition by path order by seq, sub) as bigint) as message, role, case when role = 'assistant' and shown in ('Bash', 'Edit', 'Read') then null else shown end as content from m""")
def openai_export(spark, d):
    out = exports.openai_messages(_events(spark, d))
    return out.select("path", "message", "role", F.get_json_object("content", "$.content").alias("content"))


@query("""with r as (select *, row_number() over (order by p_retailprice desc, p_partkey) as r from part) select '# Results for widget' || chr(10) || chr(10) || string_agg('## ' || r || '. ' || p_brand || chr(10) || chr(10) || '`' || p_name || '`' || chr(10) || chr(10) || '> ' || p_type, chr(10) || chr(10) order by r) as markdown from r where r <= 5""")
def search_handoff(spark, d):
    from pyspark.sql import Window

    best = read(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(5)
    r = F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey"))  # five rows
    return exports.search_handoff(best.select(r.alias("r"), F.col("p_name").alias("path"), F.col("p_brand").alias("project"), F.array("p_type").alias("snippets")), "widget")


@query("""with s as (select *, row_number() over (order by c_acctbal desc, c_custkey) as r from customer), n as (select * from s where r <= 20), c as (select o_custkey, o_orderkey, o_orderpriority, row_number() over (partition by o_custkey order by o_orderkey desc) as k from orders join n on o_custkey = c_custkey),
  l as (select o_custkey, string_agg(substring(o_orderpriority, 1, 6), '|' order by o_orderkey) as lines from c where k <= 8 group by 1) select cast(r as integer) as r, c_custkey as path, substring(c_name, 1, 6) as title, lines from n left join l on o_custkey = c_custkey""")
def standup_report(spark, d):
    s = read(spark, d, "customer").select(F.col("c_custkey").alias("path"), F.col("c_acctbal").alias("mtime"), F.col("c_name").alias("title"))
    c = read(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("prompt"))
    return exports.standup(s, c, most_chars=6).withColumn("lines", F.array_join("lines", "|"))


@query("""select 'yesterday' as kind, count(*) as n from events where ts >= timestamp '2024-01-04' and ts < timestamp '2024-01-05' union all select 'today', count(*) from events where ts >= timestamp '2024-01-05' union all select 'workday', count(*) from events where ts >= timestamp '2024-01-05 09:00' and ts < timestamp '2024-01-05 17:00'
  union all select 'previous-workday', count(*) from events where ts >= timestamp '2024-01-04 09:00' and ts < timestamp '2024-01-04 17:00' union all select '36h', count(*) from events where ts >= timestamp '2024-01-04 00:30'""")
def standup_windows(spark, d):
    """As of a Friday at half past twelve."""
    now, e = datetime(2024, 1, 5, 12, 30), read(spark, d, "events")
    kinds = ["today", "yesterday", "workday", "previous-workday", "36h"]
    counts = e.agg(*(F.count_if(filters.in_window(F.col("ts"), filters.standup_window(k, now))).alias(k) for k in kinds))
    return counts.unpivot([], kinds, "kind", "n")


@query("select o_orderkey from orders where contains(lower(o_orderpriority || chr(10) || o_orderstatus), 'urg') and o_orderkey % 3 = 0 and o_orderkey % 2 = 0")
def matching_chapters(spark, d):
    o = read(spark, d, "orders").withColumns({"prompt": F.col("o_orderpriority"), "answer": F.col("o_orderstatus"), "tools": F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("Bash"), F.lit("Edit"))).otherwise(F.array(F.lit("Read"))), "wasteful": F.col("o_orderkey") % 2 == 0})
    return o.filter(filters.chapter_matches("URG", ["Edit", "Agent"], True)).select("o_orderkey")


@query("with h as (select c_custkey, c_name, substring(sha256(c_name), 1, 8) as h from customer) select c_custkey, cast(row_number() over (order by case when h = (select h from h where c_custkey = 7) then 0 else 1 end, c_name) as integer) as place from h qualify place <= 10")
def named_session_first(spark, d):
    """The session that a search names by its hash leads the list."""
    import hashlib

    from pyspark.sql import Window

    name = hashlib.sha256(f"Customer#{7:09d}".encode()).hexdigest()[:8]
    rows = read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("path"))
    first = filters.named_first(rows, name, F.col("path").asc()).limit(10)
    place = F.row_number().over(Window.orderBy(filters.id_matches(name).desc(), "path"))  # ten rows
    return first.select("c_custkey", place.alias("place"))


@query("select c_custkey, case when c_custkey % 3 = 0 then lower(c_mktsegment) else c_mktsegment end as model, 2 as fmt from customer")
def healed_rows(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("model"), F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(2).alias("fmt"))
    return live.healed(rows, 2, lambda old: old.withColumn("model", F.lower("model")))


def _secrets(spark, d) -> DataFrame:
    """Customers' notes: some hold a token, which the next note of the session repeats."""
    k = F.col("c_custkey")
    token = F.concat(F.lit("ghp_"), F.substring(F.sha2(F.col("c_name"), 256), 1, 36))
    return read(spark, d, "customer").select((k - k % 2).alias("path"), k.alias("seq"), F.when(k % 2 == 0, F.concat(F.lit("use gh "), token, F.lit(" now"))).otherwise(F.concat(F.lit("again "), F.concat(F.lit("ghp_"), F.substring(F.sha2(F.concat(F.lit("Customer#"), F.lpad((k - 1).cast("string"), 9, "0")), 256), 1, 36)))).alias("text"), F.lit(None).cast("array<struct<id:string,name:string,input:string>>").alias("tool_calls"))


@query("select c_custkey - c_custkey % 2 as path, c_custkey as seq, case when c_custkey % 2 = 0 then 'use gh [REDACTED] now' else 'again [REDACTED]' end as text from customer")
def redacted_sessions(spark, d):
    events = _secrets(spark, d)
    return redact.redacted_session(events, redact.session_findings(events)).select("path", "seq", "text")


@query("select c_custkey - c_custkey % 2 as path, count(*) as n, count(distinct substring(sha256(case when c_custkey % 2 = 0 then c_name else 'Customer#' || lpad(cast(c_custkey - 1 as varchar), 9, '0') end), 1, 36)) as secrets, false as leaks from customer group by 1")
def session_secrets(spark, d):
    events = _secrets(spark, d)
    found = redact.session_findings(events).groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("secret").alias("secrets"))
    clean = redact.redacted_session(events, redact.session_findings(events)).groupBy("path").agg(F.max(redact.has_secret_shape(F.col("text"))).alias("leaks"))
    return found.join(clean, "path")


@query("""select c_custkey, '{"password":"kept","note":["Bearer [REDACTED]",' || c_custkey || '],"url":"https://me:[REDACTED]@x.test/' || c_custkey || '"}' as body from customer""")
def redacted_bodies(spark, d):
    k = F.col("c_custkey")
    body = F.concat(F.lit('{"password": "kept", "note": ["Bearer '), F.substring(F.sha2("c_name", 256), 1, 30), F.lit('", '), k, F.lit('], "url": "https://me:'), F.substring(F.sha2("c_name", 256), 1, 12), F.lit("@x.test/"), k, F.lit('"}'))
    return redact.redacted_json(read(spark, d, "customer").select("c_custkey", body.alias("body")), "body")
