"""Tables that work in rounds keeps between them, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, removed when the session's JVM ends; only a local session may go without the setting."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/weft-checkpoints"
    path = f"{base.rstrip('/')}/plan-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def kept(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written and read back: what follows doesn't compute it again, on whichever executors are left."""
    path = f"{folder}/{uuid.uuid4().hex}" if folder else shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def rounds(spark: SparkSession) -> Iterator[str]:
    """A folder for the tables of some rounds, removed at the end."""
    folder = shared_folder(spark)
    try:
        yield folder
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
