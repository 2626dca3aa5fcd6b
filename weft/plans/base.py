"""How queries and the SQL that checks them are kept together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import epoch_ms
from weft.operators import timing
from weft.operators.search import Index, build_index
from weft.operators.tables import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_indexes: dict[tuple, tuple[tuple, Index]] = {}


def files_of(df: DataFrame) -> tuple:
    """What tells whether the files behind ``df`` are still the same: their number, and a sum over names, sizes and times."""
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return tuple(files.agg(F.count("*"), F.sum(F.xxhash64("*").cast("decimal(20,0)"))).first())


def stored_index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of the documents: built by the first query of a session that searches, read by all others until the files change."""
    docs = read(spark, sf_dir, "documents")
    key, now = (spark.sparkContext.applicationId, sf_dir), files_of(docs)
    if key not in _indexes or _indexes[key][0] != now:
        _indexes[key] = (now, build_index(docs, shared_folder(spark)))
    return _indexes[key][1]


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a session's records: users are sessions, and event types stand for record kinds."""
    kinds = {"signup": timing.OTHER, "click": timing.USER, "view": timing.ASSISTANT, "error": timing.TOOL_RESULT, "purchase": timing.TOOL_WAIT}
    kind = F.lit(timing.OTHER)
    for name, k in kinds.items():
        kind = F.when(F.col("event_type") == name, k).otherwise(kind)
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), epoch_ms(F.col("ts")).alias("ms"), kind.alias("kind"), "event_type", "value", "props")


#: The same for DuckDB, as a common table expression.
EVENTS_SQL = """ev as (select user_id as path, event_id as seq, epoch_us(ts) // 1000 as ms, event_type, value, props,
  case event_type when 'click' then 1 when 'view' then 2 when 'error' then 3 when 'purchase' then 5 else 0 end as kind from events)"""
CALLS_SQL = EVENTS_SQL + """, calls as (select path, seq, event_type || ':' || props as sig, event_type as tool, props as target, event_type = 'error' as failed,
  row_number() over (partition by path order by seq) as ord from ev)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    ev = timed_events(spark, sf_dir)
    ord_ = F.row_number().over(Window.partitionBy("path").orderBy("seq"))
    return ev.select("path", "seq", F.concat_ws(":", "event_type", "props").alias("sig"), F.col("event_type").alias("tool"), F.col("props").alias("target"), (F.col("event_type") == "error").alias("failed"), ord_.alias("ord"))
