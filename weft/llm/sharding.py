"""Sharding by histogram sort.

Rows get a 63-bit sort key: a hash of the text above a hash of the document id, so equal texts are neighbours and a
group of copies larger than a shard can still be cut. The driver looks for the keys that split the bytes evenly:
each round counts the exact bytes between candidate keys over all partitions, keeps the candidate interval that
holds each sought splitter, and divides only those intervals in the next round, until every splitter is within the
tolerance or its interval is a single key. What a round returns is bounded by the number of splitters, not by the
rows. Then the rows move once, each to the piece of its shard.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.common import as_one, small_table, stash, table, unpacked

#: The first round has 2**FIRST_BITS candidates, later ones 2**NEXT_BITS in each open interval; they divide the key.
KEY_BITS, GROUP_BITS, FIRST_BITS, NEXT_BITS = 63, 27, 13, 10
#: Bytes of a piece, as far as a shard has no more than MOST_PIECES of them (what the driver searches for).
PIECE_BYTES, MOST_PIECES = 256 << 20, 256


def sort_key(text: Column, doc_id: Column) -> Column:
    """36 bits of the text's hash above 27 bits of the id's; null text counts as empty."""
    group = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 64 - KEY_BITS + GROUP_BITS)
    return F.shiftleft(group, GROUP_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(doc_id), 64 - GROUP_BITS))


def histogram_splitters(rows: DataFrame, shards: int, pieces: int | None, tolerance: float) -> tuple[list[int], list[int], list[int]]:
    """(ascending start keys of all pieces, the shard of each piece, single keys that a boundary falls inside of).

    ``rows`` has key and size. Piece boundaries at every ``total / (shards * pieces)`` bytes, where ``pieces`` follows
    from PIECE_BYTES and the parallelism of the session if it isn't given; those that are shard boundaries are refined to ``tolerance`` of a shard's bytes, the others to half a piece. An interval boundary
    between two groups of equal texts is preferred when it is within the tolerance.
    """
    edges: dict[int, int] = {}  # candidate key -> bytes below it
    narrow: dict[int, list[int]] = {}

    def count(width: int, inside: list[int] | None) -> None:
        """Add candidates ``2**width`` apart, in all of the key range or in the intervals that begin at ``inside``."""
        at = F.shiftright("key", width)
        some = rows if inside is None else rows.filter(F.shiftright("key", width + NEXT_BITS).isin([e >> (width + NEXT_BITS) for e in inside]))
        found = {r["at"]: r["bytes"] for r in some.groupBy(at.alias("at")).agg(F.sum("size").alias("bytes")).collect()}
        for start, n in [(0, 1 << FIRST_BITS)] if inside is None else [(e, 1 << NEXT_BITS) for e in inside]:
            below = edges.get(start, 0)
            for i in range(n):
                edges[start + (i << width)] = below
                below += found.get((start >> width) + i, 0)
        if inside is None:
            edges[1 << KEY_BITS] = below

    width = KEY_BITS - FIRST_BITS
    count(width, None)
    total = edges[1 << KEY_BITS]
    if not pieces:
        parallel = math.ceil(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) / shards)
        pieces = max(1, min(MOST_PIECES, max(parallel, math.ceil(total / shards / PIECE_BYTES))))
    n = shards * pieces
    sought = {i: total * i / n for i in range(1, n)}
    slack = {i: total / shards * tolerance if i % pieces == 0 else total / n / 2 for i in sought}
    while True:
        keys = sorted(edges)
        below = [edges[k] for k in keys]
        for i, want in sought.items():
            at = bisect_right(below, want) - 1
            narrow[i] = [keys[at], keys[min(at + 1, len(keys) - 1)]]
        if not width:
            break
        off = {i: min(abs(edges[k] - sought[i]) for k in pair) for i, pair in narrow.items()}
        inside = sorted({narrow[i][0] for i in sought if off[i] > slack[i] and narrow[i][1] - narrow[i][0] == 1 << width})
        if not inside:
            break
        width -= NEXT_BITS
        count(width, inside)
    heavy = sorted({narrow[i][0] for i in sought if not width and min(abs(edges[k] - sought[i]) for k in narrow[i]) > slack[i]})
    starts, shard_of = [0], [0]
    for i in sorted(sought):
        pick = min(narrow[i], key=lambda k: abs(edges[k] - sought[i]))
        whole = [k for k in narrow[i] if not k & ((1 << GROUP_BITS) - 1) and abs(edges[k] - sought[i]) <= slack[i]]
        pick = min(whole, key=lambda k: abs(edges[k] - sought[i])) if whole else pick
        pick = max(pick, starts[-1])
        if pick == starts[-1]:
            shard_of[-1] = i // pieces
        else:
            starts.append(pick)
            shard_of.append(i // pieces)
    return starts, shard_of, heavy


def histogram_shard(docs: DataFrame, shards: int = 16, tolerance: float = 0.001, text: str = "text", key: str = "doc_id", pieces: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with size, text_crc32, shard and slot; shards hold nearly equal bytes.

    Size: UTF-8 bytes of the text (null: none) plus 1. Null texts count as empty ones (crc32 0). Slots number the
    rows of a shard from 0 without gaps, in key order. Rows that agree in id and text stay together as far as a shard
    goes: if they are so many that a boundary falls among them, all rows are stored once with a number, and theirs
    part them. Ties are broken arbitrarily and their slots can be exchanged. An empty table gives an empty result. Added
    columns replace columns of the same name. Only built-in DataFrame functions are used.
    """
    spark = docs.sparkSession
    added = ["size", "text_crc32", "shard", "slot"]
    value, name = F.col(f"`{text}`"), F.col(f"`{key}`")
    size, crc = (F.coalesce(F.octet_length(value), F.lit(0)) + 1).cast("long"), F.crc32(F.coalesce(value, F.lit("")).cast("binary"))
    keyed = docs.select(as_one(docs), name.alias("id"), size.alias("size"), crc.alias("text_crc32"), sort_key(value, name).alias("key"))
    counted = stash(keyed.select("key", "size"))
    starts, shard_of, heavy = histogram_splitters(counted, shards, pieces, tolerance)
    if heavy:  # at most one key for each boundary
        low = F.shiftrightunsigned(F.xxhash64("tie"), 64 - GROUP_BITS)
        parted = F.shiftleft(F.shiftright("key", GROUP_BITS), GROUP_BITS).bitwiseOR(low)
        keyed = stash(keyed.withColumn("tie", F.monotonically_increasing_id())).withColumn("key", F.when(F.col("key").isin(heavy), parted).otherwise(F.col("key"))).drop("tie")
        counted = stash(keyed.select("key", "size"))
        starts, shard_of, _ = histogram_splitters(counted, shards, pieces, tolerance)

    # splitters by the first bits of the key: at most 2**FIRST_BITS rows, each with the splitters inside its interval
    cut = KEY_BITS - FIRST_BITS
    inner: dict[int, list[int]] = {}
    for s in starts:
        inner.setdefault(s >> cut, []).append(s)
    base, lookup = -1, []
    for b in range(1 << FIRST_BITS):
        lookup.append((b, base, inner.get(b, [])))
        base += len(inner.get(b, []))
    lookup = small_table(spark, lookup, "key_bin long, base_piece int, inner_starts array<bigint>")

    def with_piece(df: DataFrame) -> DataFrame:
        own = F.size(F.filter("inner_starts", lambda s: s <= F.col("key")))
        return df.withColumn("key_bin", F.shiftright("key", cut)).join(F.broadcast(lookup), "key_bin").withColumn("piece", F.col("base_piece") + own).drop("key_bin", "base_piece", "inner_starts")

    sizes = {r["piece"]: r["count"] for r in with_piece(counted).groupBy("piece").count().collect()}
    offsets, last, ahead = [], -1, 0
    for piece, shard in enumerate(shard_of):
        ahead = 0 if shard != last else ahead
        offsets.append((piece, shard, ahead))
        ahead, last = ahead + sizes.get(piece, 0), shard
    offsets = small_table(spark, offsets, "piece int, shard int, slots_before long")
    order = Window.partitionBy("piece").orderBy("key", "id", "text_crc32")
    placed = with_piece(keyed).withColumn("in_piece", F.row_number().over(order) - 1).join(F.broadcast(offsets), "piece")
    return unpacked(placed.withColumn("slot", F.col("slots_before") + F.col("in_piece")), docs.columns, added)


def op3_histogram_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = histogram_shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
