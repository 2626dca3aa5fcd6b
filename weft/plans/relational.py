"""Generic relational queries: joins of every kind, grouping sets, windows, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.plans.base import query, read


@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem
  where l_shipdate <= timestamp '1998-09-02' group by all""")
def rel_pricing_summary(spark, d):
    li = read(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey and s_nationkey = c_nationkey
  join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey where r_name = 'ASIA' group by n_name""")
def rel_local_suppliers(spark, d):
    t = {n: read(spark, d, n) for n in ("customer", "orders", "lineitem", "supplier", "nation", "region")}
    # region and nation have 5 and 25 rows, whatever the scale
    n = F.broadcast(t["nation"].join(t["region"].filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")))
    j = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["supplier"], (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    return j.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("select o_orderpriority, count(*) as n from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') group by 1")
def rel_semi_join(spark, d):
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    return o.join(li.filter("l_returnflag = 'R'"), o.o_orderkey == li.l_orderkey, "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("select c_mktsegment, count(*) as n from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F') group by 1")
def rel_anti_join(spark, d):
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    return c.join(o.filter("o_orderstatus = 'F'"), c.c_custkey == o.o_custkey, "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("select n_name, s_suppkey, c_custkey from (select n_name, n_nationkey from nation) left join (select s_nationkey, min(s_suppkey) as s_suppkey from supplier group by 1) on s_nationkey = n_nationkey full join (select c_nationkey, max(c_custkey) as c_custkey from customer group by 1) on c_nationkey = n_nationkey")
def rel_outer_joins(spark, d):
    n = read(spark, d, "nation").select("n_name", "n_nationkey")
    s = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s_suppkey"))
    c = read(spark, d, "customer").groupBy("c_nationkey").agg(F.max("c_custkey").alias("c_custkey"))
    return n.join(s, n.n_nationkey == s.s_nationkey, "left").join(c, n.n_nationkey == c.c_nationkey, "full").select("n_name", "s_suppkey", "c_custkey")


@query("""with e as (select event_id, user_id, epoch_us(ts) as t, event_type from events) select a.event_id, max_by(b.event_id, (b.t, b.event_id)) as clicked from e a join e b on a.user_id = b.user_id and b.event_type = 'click' and b.t <= a.t where a.event_type = 'purchase' group by 1""")
def rel_asof_join(spark, d):
    """Each purchase with the user's latest click: one window over both sides instead of a join of pairs."""
    e = read(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy(F.col("ts")).rangeBetween(Window.unboundedPreceding, 0)
    click = F.when(F.col("event_type") == "click", F.struct("ts", "event_id"))
    return e.withColumn("c", F.max(click).over(w)).filter("event_type = 'purchase' and c is not null").select("event_id", F.col("c.event_id").alias("clicked"))


@query("""select coalesce(p_brand, 'all') as brand, coalesce(cast(p_size as varchar), 'all') as size, count(*) as n, round(sum(p_retailprice), 2) as price from part group by cube (p_brand, p_size)""")
def rel_cube(spark, d):
    p = read(spark, d, "part")
    return p.cube("p_brand", "p_size").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("price")).select(F.coalesce("p_brand", F.lit("all")).alias("brand"), F.coalesce(F.col("p_size").cast("string"), F.lit("all")).alias("size"), "n", "price")


@query("select r_name, n_name, count(*) as n from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by rollup (r_name, n_name)")
def rel_rollup(spark, d):
    n = F.broadcast(read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    return read(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("""select o_custkey, o_orderkey, cast(rank() over w as bigint) as rk, cast(dense_rank() over w as bigint) as dr, cast(ntile(4) over w2 as bigint) as quarter, round(cume_dist() over w, 9) as cd, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows between 2 preceding and current row), 2) as moving
  from orders window w as (partition by o_custkey order by o_orderpriority), w2 as (partition by o_custkey order by o_orderkey)""")
def rel_ranking_windows(spark, d):
    o = read(spark, d, "orders")
    w, w2 = Window.partitionBy("o_custkey").orderBy("o_orderpriority"), Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return o.select("o_custkey", "o_orderkey", F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("dr"), F.ntile(4).over(w2).cast("long").alias("quarter"), F.round(F.cume_dist().over(w), 9).alias("cd"), F.round(F.sum("o_totalprice").over(w2.rowsBetween(-2, 0)), 2).alias("moving"))


@query("select l_suppkey from lineitem where l_returnflag = 'R' except all select l_suppkey from lineitem where l_returnflag = 'A'")
def rel_except_all(spark, d):
    li = read(spark, d, "lineitem")
    return li.filter("l_returnflag = 'R'").select("l_suppkey").exceptAll(li.filter("l_returnflag = 'A'").select("l_suppkey"))


@query("select s_suppkey as k from supplier union select c_custkey from customer")
def rel_union_distinct(spark, d):
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("k")).union(read(spark, d, "customer").select("c_custkey")).distinct()


@query("""select p_brand, count(*) filter (p_size <= 10) as small, count(*) filter (p_size > 10 and p_size <= 30) as medium, count(*) filter (p_size > 30) as large from part group by p_brand""")
def rel_pivot(spark, d):
    p = read(spark, d, "part").withColumn("class", F.when(F.col("p_size") <= 10, "small").when(F.col("p_size") <= 30, "medium").otherwise("large"))
    return p.groupBy("p_brand").pivot("class", ["small", "medium", "large"]).agg(F.count(F.lit(1))).select("p_brand", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("small", "medium", "large")))


@query("select c_custkey, c_name, c_acctbal from customer order by c_acctbal desc, c_custkey limit 20 offset 40")
def rel_page(spark, d):
    return read(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").offset(40).limit(20).select("c_custkey", "c_name", "c_acctbal")


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as n from events group by all")
def rel_hourly_windows(spark, d):
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("select event_type, cast(json_extract(props, '$.k') as bigint) as k, count(*) as n from events group by all")
def rel_json_fields(spark, d):
    return read(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))
