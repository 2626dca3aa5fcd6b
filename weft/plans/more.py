"""Queries on filters, order-sensitive clean-up and index statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.functions import money, records, redact, text
from weft.operators import calls as call_ops
from weft.operators import events, filters, insights, search
from weft.plans.base import EVENTS_SQL, query, read, timed_events
from weft.plans.texts import POSTINGS


def _rows(spark, d):
    """Customers as session rows."""
    c = read(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("path"), F.col("c_mktsegment").alias("project"), F.when(F.col("c_nationkey") % 5 != 0, F.concat(F.lit("h"), F.col("c_nationkey") % 5)).alias("host"), (F.col("c_custkey") % 4).cast("int").alias("errors"), (F.col("c_custkey") * 100).alias("size"), (F.col("c_custkey") * 3_600_000).alias("mtime_ms"), F.array("c_mktsegment", F.lit("Bash")).alias("tools"))


@query("select cast(c_custkey as varchar) as path from customer where contains(lower(c_mktsegment), 'build') and not (c_custkey % 4 >= 2) and (c_nationkey % 5 = 0 or c_nationkey % 5 = 2) and c_custkey * 100 // 1024 > 3 and 3600000000 - c_custkey * 3600000 < 1814400000 and c_custkey * 3600000 < 3603600000")
def filtered_sessions(spark, d):
    rows = _rows(spark, d)
    wanted = filters.project("BUILD") & ~filters.errors(">=", 2) & (filters.host("local") | filters.host("h2")) & filters.size_kb(">", 3) & filters.age("<", "3w", 1000 * 3_600_000) & filters.between(0, 1001 * 3_600_000) & filters.tool("bash")
    return rows.filter(wanted).select("path")


@query("select cast(c_custkey as varchar) as path, cast(c_custkey % 4 as integer) as errors from customer order by case when c_custkey % 4 = 0 then 1 else 0 end, c_custkey % 4, path limit 30")
def sessions_by_errors_ascending(spark, d):
    return insights.ranked(_rows(spark, d).select("path", "errors"), "errors", ascending=True).limit(30)


@query(f"with {EVENTS_SQL}, t as (select path, seq, ms - lag(ms) over (partition by path order by seq) as gap from ev) select path, seq, gap from t where gap > 30000")
def turn_gaps(spark, d):
    w = Window.partitionBy("path").orderBy("seq")
    return timed_events(spark, d).select("path", "seq", (F.col("ms") - F.lag("ms").over(w)).alias("gap")).filter("gap > 30000")


@query("select o_custkey, o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows unbounded preceding), 2) as spent from orders")
def cumulative_cost(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, d, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("spent"))


@query(f"""with {EVENTS_SQL}, a as (select path, seq, row_number() over (partition by path order by seq) as k from ev where event_type = 'click'), b as (select path, seq as seq_right, row_number() over (partition by path order by seq) as k from ev where event_type = 'view')
  select path, cast(k as integer) as k, seq, seq_right from a left join b using (path, k)""")
def positional_outcomes(spark, d):
    ev = timed_events(spark, d).select("path", "seq", "event_type")
    return events.positional_join(ev.filter("event_type = 'click'").drop("event_type"), ev.filter("event_type = 'view'").drop("event_type"), "path", "seq")


@query(f"with {EVENTS_SQL} select path, event_type, props, seq from ev qualify row_number() over (partition by path, event_type, props order by seq) = 1")
def first_results(spark, d):
    return events.first_wins(timed_events(spark, d).select("path", "event_type", "props", "seq"), ["path", "event_type", "props"], "seq")


@query(f"with {EVENTS_SQL}, t as (select path, seq, event_type, lag(event_type) over (partition by path order by seq) as before from ev) select path, seq, event_type from t where before is null or before <> event_type")
def without_mirrored_prompts(spark, d):
    return events.without_echoes(timed_events(spark, d).select("path", "seq", "event_type"), "path", "seq", ["event_type"])


@query(f"""with {EVENTS_SQL}, t as (select path, value, coalesce(sum(case when event_type = 'view' then 1 else 0 end) over (partition by path order by seq rows between unbounded preceding and 1 preceding), 0) as b, sum(case when event_type = 'view' then 1 else 0 end) over (partition by path) as n from ev)
  select path, cast(least(b, n - 1) as bigint) as owner_no, round(sum(value), 4) as value from t where n > 0 group by 1, 2""")
def credited_usage(spark, d):
    return events.credit_forward(timed_events(spark, d), "path", "seq", F.col("event_type") == "view", "value").withColumn("value", F.round("value", 4))


@query(f"""with {EVENTS_SQL}, f as (select event_type, min_by(props, seq) as example from ev group by 1) select event_type, example, count(*) filter (props = example) as same from ev join f using (event_type) group by 1, 2""")
def first_examples(spark, d):
    return events.first_example(timed_events(spark, d), ["event_type"], "seq", "props")


@query(f"""with {EVENTS_SQL}, r as (select path, props as id, seq, event_type = 'error' as is_error, last_value(case when event_type <> 'error' then event_type end ignore nulls) over (partition by path, props order by seq rows between unbounded preceding and 1 preceding) as name from ev)
  select path, id, seq, is_error, name from r where is_error""")
def results_with_calls(spark, d):
    ev = timed_events(spark, d).withColumnRenamed("props", "id")
    made = ev.filter("event_type <> 'error'").select("path", "id", "seq", F.col("event_type").alias("name"), F.lit(None).cast("string").alias("input"))
    results = ev.filter("event_type = 'error'").select("path", "id", "seq", F.lit(True).alias("is_error"))
    return call_ops.join_results(made, results).select("path", "id", "seq", "is_error", "name")


@query("with d as (select * from documents where lang = 'en'), " + POSTINGS.replace("from documents", "from d") + " select term, count(*) as df, any_value(n) as n, round(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 9) as idf from p, s where term in ('the', 'of', 'idiot') group by term")
def narrowed_statistics(spark, d):
    """Statistics of the filtered set differ from the whole index's: the filter comes first."""
    docs = read(spark, d, "documents").filter("lang = 'en'")
    n = docs.agg(F.count("*").alias("n"))
    df = search.postings(docs).filter(F.col("term").isin("the", "of", "idiot")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).withColumn("idf", F.round(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 9))


@query("select source, min(doc_id) as first_doc, count(*) as copies from documents group by source, md5(text) having count(*) > 1")
def repeated_chunks(spark, d):
    return read(spark, d, "documents").groupBy("source", F.md5("text").alias("h")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).filter("copies > 1").drop("h")


@query("select page_id, case when len(s) > 2 then s[-2] || '/' || s[-1] else url end as label from (select page_id, url, string_split(url, '/') as s from pages)")
def short_paths(spark, d):
    return read(spark, d, "pages").select("page_id", text.short_path(F.col("url")).alias("label"))


@query("select n_name as host, coalesce(c.n, 0) as sessions, newest from nation left join (select c_nationkey, count(*) as n, max(c_custkey) as newest from customer group by 1) c on c_nationkey = n_nationkey")
def host_status(spark, d):
    n = F.broadcast(read(spark, d, "nation").select("n_name", "n_nationkey"))
    c = read(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.max("c_custkey").alias("newest"))
    return n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("host"), F.coalesce("n", F.lit(0)).alias("sessions"), "newest")


@query("select c_custkey, substring(c_name, 1, 4) || '…' || right(c_name, 4) as masked from customer where length(c_name) > 8")
def masked_names(spark, d):
    return read(spark, d, "customer").filter(F.length("c_name") > 8).select("c_custkey", redact.masked(F.col("c_name")).alias("masked"))


@query("select c_custkey, cast(least(900000 * pow(2.0, least(c_custkey, 9)), 7200000) as bigint) as wait_ms, case when c_custkey >= 3600 then printf('%dh %dm', c_custkey // 3600, c_custkey % 3600 // 60) when c_custkey >= 60 then printf('%dm %ds', c_custkey // 60, c_custkey % 60) else printf('%ds', c_custkey) end as shown from customer")
def durations(spark, d):
    k = F.col("c_custkey")
    return read(spark, d, "customer").select("c_custkey", records.backoff_ms(k + 1).alias("wait_ms"), text.duration_text(k * 1000).alias("shown"))


@query("with t as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents) select doc_id, count(*) filter (trim(line) <> '') as lines from t group by doc_id")
def non_empty_lines(spark, d):
    return read(spark, d, "documents").select("doc_id", text.non_empty_lines(F.col("text")).cast("long").alias("lines"))


@query("select cast(c_custkey as varchar) as path from customer where c_mktsegment = 'BUILDING' and contains('claude-' || c_nationkey, 'claude-1') and c_custkey % 5 = 0 and c_custkey % 2 = 0")
def filtered_models(spark, d):
    k = F.col("c_custkey")
    rows = read(spark, d, "customer").select(k.cast("string").alias("path"), F.col("c_mktsegment").alias("source"), F.concat(F.lit("claude-"), "c_nationkey").alias("model"), F.when(k % 5 == 0, "A").otherwise("B").alias("grade_letter"), F.when(k % 2 == 0, True).alias("live"))
    return rows.filter(filters.source("building") & filters.model("Claude-1") & filters.grade("a") & filters.live()).select("path")


@query("select p_partkey, round(list_aggregate(list_filter(string_split(p_name, ''), lambda x: x <> ''), 'entropy'), 9) as bits, case when p_size % 2 = 0 then p_brand else p_brand || '-20250' end as model from part")
def entropies_and_models(spark, d):
    name = F.concat(F.lit("claude-"), "p_brand", F.when(F.col("p_size") % 2 == 0, "-20250101").otherwise("-20250"))
    return read(spark, d, "part").select("p_partkey", F.round(text.entropy(F.col("p_name")), 9).alias("bits"), text.short_model(name).alias("model"))


@query("select o_orderkey, case when o_orderkey % 2 = 0 and o_totalprice > 272000 then 2.0 else 1.0 end as weight_in, case when o_orderkey % 2 = 0 and o_totalprice > 272000 then 1.5 else 1.0 end as weight_out from orders")
def long_context_weights(spark, d):
    model = F.when(F.col("o_orderkey") % 2 == 0, "gpt-5.6-sol-x").otherwise("gpt-5.6")
    tokens = F.col("o_totalprice")
    return read(spark, d, "orders").select("o_orderkey", money.long_context_weight(model, tokens, False).cast("double").alias("weight_in"), money.long_context_weight(model, tokens, True).cast("double").alias("weight_out"))


@query("select c_custkey, c_name from customer order by c_acctbal desc, c_custkey limit 20 offset 40")
def third_page(spark, d):
    rows = read(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey")
    return insights.page(rows, 3, 20).select("c_custkey", "c_name")


@query("select event_id from (select event_id, case when event_id % 5 <> 0 then ts end as t from events) order by t nulls last, event_id limit 50")
def merged_order(spark, d):
    e = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("at"))
    return events.merge_order(e, "at", "event_id").limit(50).select("event_id")


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'clean' when o_orderkey % 3 = 1 then case when o_custkey % 4 >= 3 then 'struggling' when o_custkey % 4 = 2 then 'struggling' when o_custkey % 4 = 1 then 'corrected' else 'clean' end else 'corrected' end as outcome from orders")
def chapter_outcomes(spark, d):
    from weft.operators import chapters

    k, e = F.col("o_orderkey") % 3, (F.col("o_custkey") % 4).cast("int")
    zero = F.lit(0)
    return read(spark, d, "orders").select("o_orderkey", F.when(k == 0, chapters.outcome(zero, zero, zero, F.lit(False), zero)).when(k == 1, chapters.outcome(e, zero, zero, F.lit(False), F.lit(2))).otherwise(chapters.outcome(F.lit(2), F.lit(1), F.lit(1), F.lit(False), F.lit(2))).alias("outcome"))
