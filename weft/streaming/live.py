"""Incremental work on arriving events with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators import timing

#: Stop reasons after which an assistant is idle.
IDLE_STOPS = ("end_turn", "stop_sequence", "max_tokens")


def worked_time(events: DataFrame, key: str = "path") -> DataFrame:
    """(key, active_ms, n) per session as events (key, seq, ms, kind) arrive, updated with every batch.

    The state is the latest time, the kind of the last message and the sums; no event is late, since gaps count from
    the latest time seen. Within a batch events are taken in order of ``seq``.
    """

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        latest, last, active, n = state.get if state.exists else (None, timing.OTHER, 0, 0)
        rows = pd.concat([b[["seq", "ms", "kind"]] for b in batches]).sort_values("seq")
        for ms, kind in zip(rows["ms"].tolist(), rows["kind"].tolist(), strict=True):
            n += 1
            if pd.isna(ms):
                continue
            gap = 0 if latest is None else ms - latest
            answered = kind == timing.ASSISTANT and last in (timing.TOOL_RESULT, timing.TOOL_WAIT)
            if gap > 0 and (gap <= timing.STALL or kind == timing.TOOL_WAIT and gap <= timing.TOOL_WAIT_MOST or (kind == timing.MODEL_STEP or answered) and gap <= timing.MODEL_WAIT):
                active += int(gap)
            latest = int(ms) if latest is None else max(latest, int(ms))
            last = last if kind == timing.OTHER else kind
        state.update((latest, last, active, n))
        yield pd.DataFrame({key: [keys[0]], "active_ms": [active], "n": [n]})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} long, active_ms long, n long", "latest long, last int, active long, n long", "update", "NoTimeout")


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str | None = None) -> DataFrame:
    """(hour, event_type, n). No event is dropped unless ``late`` bounds how late one may come: then closed windows
    leave the state once the watermark has passed them."""
    w = (events.withWatermark("ts", late) if late else events).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("hour"), "event_type", "n")


def upserting(path: str, key: str, version: str):
    """A ``foreachBatch`` function that keeps one row for each key: that of the highest version.

    Each batch is written to a folder of its own, named by its number, so a batch that is run again replaces itself;
    ``latest`` reads the table.
    """

    def write(batch: DataFrame, number: int) -> None:
        best = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), version).alias("row")).select("row.*")
        best.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest(spark, path: str, key: str, version: str) -> DataFrame:
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(version, "batch")).alias("row")).select("row.*")


def generating(events: DataFrame, key: str = "path") -> DataFrame:
    """(key, generating, pending, n) as events (key, seq, type, tool_use_id, stop, interrupted) arrive: whether a session is at work.

    It is while calls wait for results, after a prompt, and after an assistant turn that didn't end. An interruption
    ends the turn. The state is the set of open calls and the last turn.
    """

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pending, last, stop, n = state.get if state.exists else ("", "", "", 0)
        open_ = set(pending.split("\n")) - {""}
        rows = pd.concat([b[["seq", "type", "tool_use_id", "stop", "interrupted"]] for b in batches]).sort_values("seq")
        for type_, id_, stopped, interrupted in zip(rows["type"], rows["tool_use_id"], rows["stop"], rows["interrupted"], strict=True):
            n += 1
            if interrupted:
                open_, last = set(), "interrupted"
            elif type_ == "call":
                last, stop = "assistant", "tool_use"
                open_ |= {id_} - {None}
            elif type_ == "assistant":
                last, stop = "assistant", stopped or ""
            elif type_ == "tool_result":
                open_.discard(id_)
                last = "user"
            elif type_ == "user":
                last = "user"
        state.update(("\n".join(sorted(open_)), last, stop, n))
        yield pd.DataFrame({key: [keys[0]], "generating": [bool(open_) or last == "user" or last == "assistant" and stop not in IDLE_STOPS], "pending": [len(open_)], "n": [n]})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} long, generating boolean, pending int, n long", "pending string, last string, stop string, n long", "update", "NoTimeout")


def indexing(folder: str, key: str = "doc_id", text: str = "text", version: str = "mtime"):
    """A ``foreachBatch`` function that keeps postings and lengths of the newest version of each document below ``folder``.

    A batch is written to folders of its own number, so one that runs again replaces itself; ``current_index`` reads
    what is newest, and until a batch is done readers see the index without it.
    """
    from weft.operators.search import doc_lengths, postings

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), version).alias("row")).select("row.*").persist()
        versions = newest.select(key, version)
        postings(newest, key, text).join(versions, key).write.mode("overwrite").parquet(f"{folder}/postings/batch={number}")
        doc_lengths(newest, key, text).join(versions, key).write.mode("overwrite").parquet(f"{folder}/lengths/batch={number}")
        newest.unpersist()

    return write


def current_index(spark, folder: str, key: str = "doc_id", version: str = "mtime", present: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of the newest version of each document, without those that are no longer ``present``."""
    lengths = spark.read.parquet(f"{folder}/lengths")
    lengths = lengths.join(present.select(key), key, "left_semi") if present is not None else lengths
    newest = lengths.groupBy(key).agg(F.max_by(F.struct("dl", version, "batch"), F.struct(version, "batch")).alias("row")).select(key, "row.*")
    post = spark.read.parquet(f"{folder}/postings").join(newest.select(key, version, "batch"), [key, version, "batch"], "left_semi")
    return post.select(key, "term", "tf"), newest.select(key, "dl")


def compact(spark, path: str, into: str, key: str, version: str) -> None:
    """Write the table of ``upserting`` as one batch below ``into``: many small batches become one."""
    latest(spark, path, key, version).write.mode("overwrite").parquet(f"{into}/batch=0")


def healed(rows: DataFrame, now: int, heal, fmt: str = "fmt") -> DataFrame:
    """``rows`` with those of an older format than ``now`` put right once by ``heal`` (a function of DataFrames)."""
    old = heal(rows.filter(F.coalesce(F.col(fmt), F.lit(0)) < now)).withColumn(fmt, F.lit(now))
    return rows.filter(F.col(fmt) >= now).unionByName(old)
