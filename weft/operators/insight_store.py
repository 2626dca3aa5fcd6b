"""Insights kept up to date: facts of each session, and sums over all of them that changed sessions move.

A run analyses the sessions whose (path, mtime) it doesn't have in the present version of the analysis. What such a
session, or one that is gone, gave before is subtracted from the sums, and what it gives now is added; no other session
is read. Facts lie in folders of their path's bucket, so a run reads back only the buckets of the paths that changed.
Sums are exact decimals, so subtracting leaves nothing behind.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXACT = "decimal(38,9)"


def measures(facts: DataFrame, numbers: list[str], groups: list[str], maps: list[str]) -> DataFrame:
    """(name, value, n) that add up over sessions, each session's own.

    ``sessions`` counts them, ``numbers`` are sums, every one of ``groups`` has sessions and numbers of each of its
    values (rows without a value are in no group), and a map (key to number) gives sums and sessions of its keys.
    """
    exact = lambda c: F.coalesce(c.cast(EXACT), F.lit(0).cast(EXACT))
    entry = lambda name, value, n: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"), exact(n).alias("n"))
    none, one = F.lit(None), F.lit(1)
    parts: list[Column] = [F.array(entry("sessions", none, one), *(entry(c, none, F.col(c)) for c in numbers))]
    for g in groups:
        own = F.array(entry(f"{g}.sessions", F.col(g), one), *(entry(f"{g}.{c}", F.col(g), F.col(c)) for c in numbers))
        parts.append(F.filter(own, lambda x: x["value"].isNotNull()))

    def keyed(name: str, amounts: bool) -> Callable[[Column], Column]:
        return lambda e: entry(name, e["key"], e["value"] if amounts else one)

    for m in maps:
        entries = F.coalesce(F.map_entries(m), F.array().cast(facts.select(F.map_entries(m)).schema[0].dataType))
        parts += [F.transform(entries, keyed(m, True)), F.transform(entries, keyed(f"{m}.sessions", False))]
    return facts.select("path", F.inline(F.concat(*parts)))


class InsightStore:
    """The store below ``folder``; ``version`` is that of the analysis, of another all sessions are analysed anew."""

    def __init__(self, spark: SparkSession, folder: str, numbers: list[str], groups: list[str], maps: list[str], version: int = 1, buckets: int = 64):
        self.spark, self.folder, self.version, self.buckets = spark, folder, version, buckets
        self.numbers, self.groups, self.maps = numbers, groups, maps

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self) -> int:
        """How many runs are whole."""
        path, store = self._path("sums")
        names = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
        return max((int(n) + 1 for n in names if n.isdigit() and store.exists(self._path(f"sums/{n}/_SUCCESS")[0])), default=0)

    def _states(self, run: int) -> DataFrame:
        """(path, mtime, v, run, gone): the newest state of each path before ``run``."""
        rows = self.spark.read.parquet(f"{self.folder}/states").filter(F.col("run") < run)
        return rows.groupBy("path").agg(F.max_by(F.struct("mtime", "v", "run", "gone"), "run").alias("s")).select("path", "s.*").filter("not gone")

    def refresh(self, sessions: DataFrame, analyse: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
        """Bring the store up to ``sessions`` (path, mtime); give how many were analysed, reused, failed and removed.

        ``analyse`` gets (path, mtime) of what changed and gives path and the facts; a session it gives nothing for has
        failed: it has no facts, and is tried again by the next run. A run that broke off is written again by the next.
        """
        run = self.runs()
        now = sessions.select("path", "mtime").dropDuplicates(["path"])
        known = self._states(run) if run else self.spark.createDataFrame([], "path string, mtime long, v int, run int, gone boolean")
        same = known.filter(F.col("v") == self.version).select("path", F.col("mtime").alias("had"))
        both = now.join(same, "path", "left")
        changed = both.filter(F.col("had").isNull() | ~F.col("had").eqNullSafe(F.col("mtime"))).select("path", "mtime")
        bucket = F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int").alias("bucket")
        fresh = analyse(changed).join(changed, "path")
        fresh.select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/facts/{run:06d}")
        made = self._facts(run, fresh.schema)
        done = made.select("path", "mtime", F.lit(self.version).alias("v"), F.lit(False).alias("gone"))
        # what the sums no longer hold: states of paths that are gone, or were tried again, failed or not
        over = known.select("path", F.col("run").alias("was")).join(now.select("path"), "path", "left_anti").unionByName(known.select("path", F.col("run").alias("was")).join(changed.select("path"), "path", "left_semi"))
        lost = over.select("path").join(done.select("path"), "path", "left_anti").select("path", F.lit(None).cast("long").alias("mtime"), F.lit(self.version).alias("v"), F.lit(True).alias("gone"))
        done.unionByName(lost).write.mode("overwrite").parquet(f"{self.folder}/states/run={run}")
        moves = self._measures(made)
        old = over.withColumn("bucket", bucket).persist()
        for was, buckets in sorted((r["was"], r["b"]) for r in old.groupBy("was").agg(F.collect_set("bucket").alias("b")).collect()):  # a row for each run, with at most ``buckets`` numbers
            facts = self._facts(was, None).filter(F.col("bucket").isin(buckets)).join(old.filter(F.col("was") == was).select("path"), "path", "left_semi")
            moves = moves.unionByName(self._measures(facts).withColumn("n", -F.col("n")))
        if run:
            moves = moves.unionByName(self.sums(run - 1))
        sums = moves.groupBy("name", "value").agg(F.sum("n").cast(EXACT).alias("n")).filter((F.col("n") != 0) | F.col("value").isNull())
        sums.write.mode("overwrite").parquet(f"{self.folder}/sums/{run:06d}")
        old.unpersist()
        analysed, tried, all_now, before = made.count(), changed.count(), now.count(), known.count()
        removed = before - known.join(now.select("path"), "path", "left_semi").count()
        return {"analyzed": analysed, "reused": all_now - tried, "failed": tried - analysed, "removed": removed}

    def _facts(self, run: int, schema) -> DataFrame:
        reader = self.spark.read
        if schema is not None:  # a run that analysed nothing has no file to tell the columns
            reader = reader.schema(json_schema(schema))
        return reader.parquet(f"{self.folder}/facts/{run:06d}")

    def _measures(self, facts: DataFrame) -> DataFrame:
        return measures(facts, self.numbers, self.groups, self.maps).drop("path")

    def sums(self, run: int | None = None) -> DataFrame:
        """(name, value, n) over all sessions as of the newest run; a few rows for each value of the groups and keys."""
        return self.spark.read.parquet(f"{self.folder}/sums/{self.runs() - 1 if run is None else run:06d}")

    def facts(self) -> DataFrame:
        """The facts of all sessions, for reports that don't add up (examples, the longest)."""
        runs = self.runs()
        states = self._states(runs).select("path", "run")
        used = [r["run"] for r in states.select("run").distinct().collect()]  # a row for each run
        frames = [self._facts(r, None).join(states.filter(F.col("run") == r).select("path"), "path", "left_semi") for r in sorted(used)]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out.drop("bucket")


def json_schema(schema):
    """``schema`` with the bucket that partitions facts."""
    from pyspark.sql.types import IntegerType, StructField, StructType

    return StructType([*StructType.fromJson(json.loads(schema.json())).fields, StructField("bucket", IntegerType())])
