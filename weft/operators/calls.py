"""Repeated, failed and chained calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retries(calls: DataFrame, key: str = "path", within: int = 20) -> DataFrame:
    """(key, retries): calls (key, ord, sig, failed) whose signature failed at most ``within`` calls before."""
    before = Window.partitionBy(key, "sig").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("failed"), F.col("ord")), ignorenulls=True).over(before)
    return calls.withColumn("again", F.coalesce(F.col("ord") - last <= within, F.lit(False))).groupBy(key).agg(F.count_if("again").alias("retries"))


def loops(calls: DataFrame, key: str = "path", repeats: int = 3, window: int = 12) -> DataFrame:
    """(key, loops, loop_calls): signatures seen ``repeats`` times or more within ``window`` calls.

    ``ord`` numbers a session's calls without gaps, so a RANGE frame over it counts calls.
    """
    frame = Window.partitionBy(key, "sig").orderBy("ord").rangeBetween(-(window - 1), 0)
    seen = calls.withColumn("seen", F.count("*").over(frame)).groupBy(key, "sig").agg(F.max("seen").alias("seen"))
    return seen.groupBy(key).agg(F.count_if(F.col("seen") >= repeats).alias("loops"), F.sum(F.when(F.col("seen") >= repeats, F.col("seen")).otherwise(0)).alias("loop_calls"))


def transitions(calls: DataFrame, group: list[str], tool: str = "tool") -> DataFrame:
    """(tool, next_tool, n): how often one tool follows another inside a group."""
    follows = F.lead(tool).over(Window.partitionBy(*group).orderBy("ord"))
    return calls.withColumn("next_tool", follows).filter("next_tool is not null").groupBy(tool, "next_tool").agg(F.count("*").alias("n"))


def error_streaks(steps: DataFrame, key: str = "path", least: int = 2) -> DataFrame:
    """(key, start_ord, length): runs of consecutive failed steps (key, ord, failed)."""
    w = Window.partitionBy(key).orderBy("ord")
    island = F.row_number().over(w) - F.sum(F.col("failed").cast("int")).over(w)
    return steps.withColumn("island", island).filter("failed").groupBy(key, "island").agg(F.min("ord").cast("long").alias("start_ord"), F.count("*").alias("length")).filter(F.col("length") >= least).drop("island")


def self_corrections(calls: DataFrame, key: str = "path", within: int = 3) -> DataFrame:
    """(key, corrections): failed calls followed within ``within`` calls by a success on the same target."""
    w = Window.partitionBy(key).orderBy("ord")
    ok = None
    for i in range(1, within + 1):
        hit = (F.lead("target", i).over(w) == F.col("target")) & ~F.lead("failed", i).over(w)
        ok = hit if ok is None else F.coalesce(ok, F.lit(False)) | F.coalesce(hit, F.lit(False))
    return calls.withColumn("fixed", F.col("failed") & F.coalesce(ok, F.lit(False))).groupBy(key).agg(F.count_if("fixed").alias("corrections"))


def join_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results with the latest earlier call of their id (path, id, seq); null ids never join."""
    both = calls.select("path", "id", "seq", F.struct("name", "input").alias("call")).unionByName(results.select("path", "id", "seq", F.lit(None).cast("struct<name:string,input:string>").alias("call"), "is_error"), allowMissingColumns=True)
    w = Window.partitionBy("path", "id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    known = both.filter("id is not null").withColumn("of", F.last("call", ignorenulls=True).over(w))
    anonymous = both.filter("id is null").withColumn("of", F.lit(None).cast("struct<name:string,input:string>"))
    return known.unionByName(anonymous).filter("call is null").select("path", "id", "seq", "is_error", "of.name", "of.input")
