"""Helpers that several training-data operators share."""

from __future__ import annotations

import gc
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir`` that is removed when the session's JVM ends.

    The setting names storage that driver and executors share. Only a local session may go without it.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/weft-checkpoints"
    path = f"{base.rstrip('/')}/weft-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def store_of(folder: str):
    """A file system by which tasks reach ``folder`` without Spark, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: short lineage that outlives executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    if (open_ := _scratch.get()) is not None:
        open_.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes at its end what was stashed within (the list of folders that it gives).

    Without this a job of many rounds keeps all of them on disk until the session ends. Spark drops shuffle files once
    the driver has collected the plans they belong to, so that is asked for as well.
    """
    own: list[str] = []
    token = _scratch.set(own)
    try:
        yield own
    finally:
        _scratch.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in own:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
        gc.collect()
        jvm.System.gc()


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives, stashed; whatever ``build`` stashed on the way to it is removed."""
    outer = _scratch.get()
    with scratch(spark):
        df = build()
        token = _scratch.set(outer)
        try:
            return stash(df)
        finally:
            _scratch.reset(token)


def collected(spark: SparkSession) -> None:
    """Have every executor collect its garbage and give memory back, between steps of a job that runs for long.

    A heap stays as large as any step once made it, and buffers outside of it stay until what refers to them, which has
    grown old by then, is collected. So without this a job takes the memory of all its steps, not of the largest one.
    """
    n = spark.sparkContext.defaultParallelism  # as many tasks as there are cores, so each executor gets one
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows that the driver holds, as one literal of the plan."""
    names = [c.split()[0] for c in schema.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{re.sub(r'(^|, )(\w+) ', r'\1\2: ', schema)}>>")))


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Consecutive slices of Arrow batches whose texts have about ``most`` bytes in all, and the texts of each.

    Spark bounds a batch by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``), so what a worker holds doesn't
    depend on how long texts are. A single longer text is a slice of its own.
    """
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.flatnonzero(np.diff((np.cumsum(size) - size) // most, append=-1)) + 1
        start = 0
        for end in ends.tolist():
            part = batch.slice(start, end - start)
            yield part, part.column(text).to_pylist()
            start = end


#: What a worker keeps from task to task, of the kind of task it did last (the pieces a tokenizer was asked about).
held: dict = {}


def task_of(run: Callable, holds: bool = False) -> Callable:
    """``run`` (batches to batches) that gives memory back when its task ends, and begins without what other tasks held.

    Python workers wait for later tasks, and more of them wait than work; what the allocators of one hold on to, an
    executor lacks.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        if not holds:
            held.clear()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library than glibc
                pass

    return whole


def dealt(docs: DataFrame) -> DataFrame:
    """``docs``, with Spark's default of 10,000 rows a batch set to 1000 unless the session has another setting.

    Batches are bounded by bytes anyhow; but vectors of tens of MB for each task and direction lie outside the heap.
    """
    conf = docs.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return docs


def with_columns_of(docs: DataFrame, fields: str, compute: Callable[..., list], text: str = "text", start: Callable[[], object] | None = None) -> DataFrame:
    """``docs`` without ``text``, and the columns ``fields`` that ``compute`` gives for a list of texts.

    The other columns stay what they are: they pass as Arrow data and never become Python or pandas values, which
    would turn whole numbers beside a null into floating-point ones. What ``start`` gives at the beginning of a task
    (a model) is handed to ``compute`` behind the texts and freed at its end.
    """
    kept, added = StructType([f for f in docs.schema.fields if f.name != text]), StructType.fromDDL(fields)
    schema = StructType([*kept.fields, *added.fields])
    names, carried, kinds = schema.names, kept.names, [f.type for f in to_arrow_schema(added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = (start(),) if start else ()
        for part, texts in text_slices(batches, text):
            got = [pa.array(values, kind) for values, kind in zip(compute(texts, *more), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), *got], names)

    return dealt(docs).mapInArrow(task_of(run), schema)


def rows_whose(docs: DataFrame, good: Callable[..., list[bool]], text: str = "text", start: Callable[[], object] | None = None) -> DataFrame:
    """The rows of ``docs`` for whose texts ``good`` says so; all columns pass as Arrow data. ``start``: as above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = (start(),) if start else ()
        for part, texts in text_slices(batches, text):
            yield part.filter(pa.array(good(texts, *more), pa.bool_()))

    return dealt(docs).mapInArrow(task_of(run), docs.schema)


def as_one(docs: DataFrame, name: str = "row") -> Column:
    """All columns of ``docs`` as one struct: no name that an operator uses inside can clash with theirs."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(name)


def unpacked(df: DataFrame, columns: list[str], added: list[str], row: str = "row") -> DataFrame:
    """The columns of ``row`` again and ``added`` beside them; an added column replaces one of the same name."""
    own = [c for c in columns if c.lower() not in {a.lower() for a in added}]
    return df.select(*(F.col(row)[c].alias(c) for c in own), *added)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as ``name``, evaluated once a row however often later columns use it.

    Spark merges projections and would repeat a costly expression in each; it doesn't merge across a generator.
    """
    return df.drop(name).select("*", F.explode(F.array(value)).alias(name))


def root_buckets(count: Column, *key: Column) -> Column:
    """Bucket number of a row in a group of ``count`` rows: about sqrt(count) buckets of sqrt(count) rows.

    However large one group is, no task then holds more than the square root of it.
    """
    return F.pmod(F.xxhash64(*key), F.ceil(F.sqrt(count)).cast("long"))


def group_rank(df: DataFrame, group: str, counts: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in buckets, so that a hot group is spread.

    ``counts`` holds ``group`` and ``group_n``; it is broadcast, so its size must be bounded by the caller.
    """
    bucketed = df.join(F.broadcast(counts), group).withColumn("group_bucket", root_buckets("group_n", *order))
    within = Window.partitionBy(group, "group_bucket").orderBy(F.xxhash64(*order), *order)
    ahead = Window.partitionBy(group).orderBy("group_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy(group, "group_bucket").agg(F.count("*").alias("bucket_n")).withColumn("bucket_start", F.coalesce(F.sum("bucket_n").over(ahead), F.lit(0)))
    ranked = bucketed.withColumn("rank_within", F.row_number().over(within) - 1)
    return ranked.join(offsets, [group, "group_bucket"]).withColumn(name, F.col("bucket_start") + F.col("rank_within")).drop("group_n", "group_bucket", "bucket_n", "bucket_start", "rank_within")
