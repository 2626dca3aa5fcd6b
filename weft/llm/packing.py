"""Packing token sequences by minimum bin slack.

Only lengths matter to packing, and a sequence of ``capacity`` tokens knows at most ``capacity`` different lengths.
So the plan is made on a histogram: the longest waiting length opens a window, a subset-sum dynamic program over the
remaining lengths (bits of one integer mark the reachable fills) finds the fill closest to capacity, and
backtracking through the program's steps gives how many pieces of each length to take. The pattern is repeated as
often as the counts allow, so a plan has some thousand patterns however many pieces there are. Then each piece finds
its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import dealt, group_rank, small_table, stash, table, task_of, text_slices

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Lengths to take, with how many of each: the longest length and the multiset that leaves the least slack."""
    longest = max(counts)
    goal = capacity - longest
    reach, steps = 1, []
    mask = (1 << (goal + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, take = counts[length] - (length == longest), 1
        left = min(left, goal // length)
        while left > 0 and not reach >> goal & 1:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left, take = left - take, take * 2
        if reach >> goal & 1:
            break
    best, found = reach.bit_length() - 1, {longest: 1}
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            found[length] = found.get(length, 0) + take
            best -= length * take
    return found


def plan_windows(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, repetitions) pairs that use every length as often as ``counts`` says."""
    left, plan = dict(counts), []
    while left:
        pattern = fill(left, capacity)
        times = min(left[n] // k for n, k in pattern.items())
        plan.append((pattern, times))
        for n, k in pattern.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return plan


def encode_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, text: str, key: str, by_words: bool, keep_ids: bool) -> DataFrame:
    """Pieces of at most ``capacity`` ids; all but a document's last are full."""
    schema = PIECES + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from weft.llm.encoding import encoder

        encode = encoder(vocabulary, by_words).encode
        for part, texts in text_slices(batches):
            row, start, length, crc, whole, kept = [], [], [], [], [], []
            for i, ids in enumerate(encode(texts)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), capacity):
                    piece = ids[at : at + capacity]
                    row.append(i)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    whole.append(len(ids))
                    if keep_ids:
                        kept.append(piece.astype(np.int32))
            columns = [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(whole, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int32()))] * keep_ids, [c.split()[0] for c in schema.split(", ")])

    return dealt(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(task_of(run, holds=True), schema)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 2048, text: str = "text", key: str = "doc_id", by_words: bool = True, keep_ids: bool = False) -> DataFrame:
    """Every document's ids (with ``end_id`` appended) in pieces, placed in sequences of at most ``capacity`` ids.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids on demand. A null text is an
    empty one: its document is the end id alone. Null ids are kept; repeated rows are packed as often as they occur.
    Documents of any length are cut at multiples of ``capacity``. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = stash(encode_pieces(docs, vocabulary, end_id, capacity, text, key, by_words, keep_ids))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, sequence = [], 0
    used = dict.fromkeys(counts, 0)
    for pattern, times in plan_windows(counts, capacity):
        offset = 0
        for length, each in sorted(pattern.items(), reverse=True):
            slots.append((length, used[length], used[length] + each * times, each, sequence, offset))
            used[length] += each * times
            offset += length * each
        sequence += times
    slots = small_table(spark, slots, "length int, rank_from long, rank_to long, each long, first_sequence long, first_offset long")
    sizes = small_table(spark, list(counts.items()), "length int, group_n long")
    # counts and slots are bounded by the capacity, not by the documents
    ranked = group_rank(pieces, "length", sizes, [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], "length_rank")
    placed = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (F.col("length_rank") >= F.col("rank_from")) & (F.col("length_rank") < F.col("rank_to"))).drop(slots["length"])
    nth = F.col("length_rank") - F.col("rank_from")
    out = placed.withColumns({"sequence_id": (F.col("first_sequence") + F.floor(nth / F.col("each"))).cast("long"), "offset": (F.col("first_offset") + nth % F.col("each") * F.col("length")).cast("long")})
    return out.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else []))


def op4_slack_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
