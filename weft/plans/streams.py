"""Streaming queries, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.plans.analysis import STEPS_SQL
from weft.plans.base import SQL, query, read, shared_folder, timed_events
from weft.streaming import live


class _Streamed:
    """A session whose tables are streams."""

    def __init__(self, spark):
        self.spark = spark
        self.read = self

    def parquet(self, path: str):
        folder, _, name = path.rpartition("/")
        return self.spark.readStream.schema(self.spark.read.parquet(path).schema).option("pathGlobFilter", name).parquet(folder)


@query("with a as (" + SQL["worked_time"] + "), n as (select user_id as path, count(*) as n from events group by 1) select path, active_ms, n from a join n using (path)")
def stream_worked_time(spark, d):
    out = shared_folder(spark)
    live_rows = live.worked_time(timed_events(_Streamed(spark), d).select("path", "seq", "ms", "kind"))
    run = live_rows.writeStream.outputMode("update").foreachBatch(live.upserting(f"{out}/table", "path", "n")).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return live.latest(spark, f"{out}/table", "path", "n")


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as n from events group by all")
def stream_hourly_counts(spark, d):
    out = shared_folder(spark)
    counted = live.windowed_counts(read(_Streamed(spark), d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("key", F.concat_ws("|", "hour", "event_type"))
    run = counted.writeStream.outputMode("update").foreachBatch(live.upserting(f"{out}/table", "key", "n")).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return live.latest(spark, f"{out}/table", "key", "n").select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n")




GENERATING = """a as (select *, case when type = 'assistant' and seq % 2 = 0 then 'end_turn' end as stop, type = 'user' and seq % 7 = 0 as interrupted from st), cut as (select path, max(seq) filter (interrupted) as stopped from a group by path),
  k as (select a.*, coalesce(seq > stopped, true) as counts from a join cut using (path)), o as (select path, tool_use_id, arg_max(type, seq) as last from k where counts and tool_use_id is not null and type in ('call', 'tool_result') group by all), pend as (select path, count(*) as pending from o where last = 'call' group by path),
  l as (select path, count(*) as n, arg_max(case when interrupted then 'interrupted' when type = 'tool_result' then 'user' when type = 'call' then 'assistant' else type end, seq) as last, arg_max(case when type = 'call' then 'tool_use' else coalesce(stop, '') end, seq) filter (type in ('call', 'assistant')) as stop from a group by path)
  select path, cast(coalesce(pending, 0) as integer) as pending, coalesce(pending, 0) > 0 or last = 'user' or (last = 'assistant' and stop <> 'end_turn') as generating, n from l left join pend using (path)"""


@query(f"with {STEPS_SQL}, {GENERATING}")
def stream_generating(spark, d):
    """Steps as a stream: prompts whose number seven divides are interruptions, every second text ends its turn."""
    out = shared_folder(spark)
    ev = read(_Streamed(spark), d, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), "event_type")
    type_ = F.when(F.col("event_type") == "view", "call").when(F.col("event_type") == "click", "user").when(F.col("event_type") == "signup", "assistant").otherwise("tool_result")
    steps = ev.withColumn("type", type_).select("path", "seq", "type", F.when(F.col("type").isin("call", "tool_result"), (F.expr("seq div 4") % 9).cast("string")).alias("tool_use_id"), F.when((F.col("type") == "assistant") & (F.col("seq") % 2 == 0), "end_turn").alias("stop"), ((F.col("type") == "user") & (F.col("seq") % 7 == 0)).alias("interrupted"))
    run = live.generating(steps).writeStream.outputMode("update").foreachBatch(live.upserting(f"{out}/table", "path", "n")).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return live.latest(spark, f"{out}/table", "path", "n")


@query("select * from (" + SQL["vocabulary"].replace("select term, count(*) as df, cast(sum(tf) as bigint) as total from p group by term", "select term, count(*) as df, cast(sum(tf) as bigint) as total from p where doc_id % 3 <> 0 group by term") + ") t")
def stream_index(spark, d):
    """Two versions of the documents arrive as a stream, the first with other texts; a third of them is then gone."""
    out = shared_folder(spark)
    docs = read(spark, d, "documents").select("doc_id", "text")
    for mtime, t in ((1, F.lit("an older text")), (2, F.col("text"))):
        docs.select("doc_id", t.alias("text"), F.lit(mtime).alias("mtime")).write.parquet(f"{out}/in/mtime_{mtime}")
    stream = spark.readStream.schema("doc_id long, text string, mtime int").option("maxFilesPerTrigger", 1 << 20).parquet(f"{out}/in/*")
    run = stream.writeStream.foreachBatch(live.indexing(f"{out}/index")).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    post, _ = live.current_index(spark, f"{out}/index", present=docs.filter("doc_id % 3 <> 0"))
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
