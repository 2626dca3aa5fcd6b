"""SimHash near-duplicates found by multi-index hashing.

A fingerprint has a bit for each majority among the hashes of a text's word shingles. Equal fingerprints are one
entry from here on, so a group of copies of any size costs one row. Every fingerprint is cut into two segments of 32
bits; each segment value is an entry of that segment's table, and each fingerprint probes the table with the Hamming
ball of radius 1 around its segment (only with bits that it lacks: the other side of a pair has them). Matches are
verified over the complete distance inside the join, and links join into components.

Fingerprints within 3 bits differ by at most 1 bit in one of the segments, so no link is lost. An entry has at most
``C(64, 1) + C(64, 2) + C(64, 3)`` linked fingerprints, whatever the number of documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import as_one, settled, stash, table, unpacked, with_columns_of
from weft.llm.graph import components, join_counted

SEED, DISTANCE, SEGMENT = 42, 3, 32


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the 64-bit hashes, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int) -> int:
    """A signed 64-bit integer; zero for a text without words.

    A-Z are lower-cased, words are runs of other characters than space and U+0009 to U+000D. A shingle counts as
    often as it occurs; a text with fewer words than ``shingle`` is one shingle.
    """
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    size = min(shingle, len(tokens))
    last = ends[size - 1 :].tolist()
    first = [0, *(ends[: len(tokens) - size] + 1).tolist()]
    return majority(np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, len(first)))


def _segments(each) -> Column:
    """``each`` applied to both segments of f0: a key holds the segment's number above its value."""
    cut = ((i, F.shiftrightunsigned("f0", i * SEGMENT).bitwiseAND(F.lit((1 << SEGMENT) - 1))) for i in range(64 // SEGMENT))
    return F.flatten(F.array(*(each(F.lit(i << SEGMENT).cast("long"), v) for i, v in cut)))


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def star_pairs(entries: DataFrame) -> DataFrame:
    """(a, b): entries (id, f0) within DISTANCE of one of four representatives of a table's bucket.

    A bucket gives at most four rows for each of its entries. What these links join needs no further pairs.
    """
    stored = entries.select("id", "f0", F.explode(_segments(lambda s, v: F.array(s.bitwiseOR(v)))).alias("key"))
    own, order = F.struct("id", "f0"), F.xxhash64("id")
    chosen = stored.groupBy("key").agg(F.count("*").alias("n"), F.array(F.min(own), F.max(own), F.min_by(own, order), F.max_by(own, order)).alias("reps")).filter("n > 1").drop("n")
    near = F.filter("reps", lambda r: (r["id"] != F.col("id")) & (_apart(F.col("f0"), r["f0"]) <= DISTANCE))
    return stored.join(chosen, "key").select("id", F.explode(F.array_distinct(F.transform(near, lambda r: r["id"]))).alias("b")).select(F.col("id").alias("a"), "b")


def mih_pairs(entries: DataFrame) -> DataFrame:
    """(a, label, b, to): ids and labels of entries (id, label, f0) within DISTANCE; pairs of one label are left out."""

    def ball(number: Column, value: Column) -> Column:
        near = F.array(*(F.when(value.bitwiseAND(F.lit(1 << b)) == 0, value.bitwiseOR(F.lit(1 << b))) for b in range(SEGMENT)))
        return F.concat(
            F.array(F.struct(number.bitwiseOR(value).alias("key"), F.lit(True).alias("same"))),
            F.transform(F.array_compact(near), lambda v: F.struct(number.bitwiseOR(v).alias("key"), F.lit(False).alias("same"))),
        )

    stored = entries.select(F.col("id").alias("b"), F.col("label").alias("to"), F.col("f0").alias("g0"), F.explode(_segments(lambda s, v: F.array(s.bitwiseOR(v)))).alias("key"))
    probes = entries.select(F.col("id").alias("a"), "label", "f0", F.explode(_segments(ball)).alias("probe")).select("a", "label", "f0", "probe.key", "probe.same")
    met = (F.col("p.key") == F.col("s.key")) & (F.col("label") != F.col("to")) & (_apart(F.col("f0"), F.col("g0")) <= DISTANCE) & (~F.col("same") | (F.col("a") < F.col("b")))
    return probes.alias("p").join(stored.alias("s"), met).select("a", "label", "b", "to")


def linked_components(entries: DataFrame) -> DataFrame:
    """(node, component) of distinct fingerprints (id, f0): stars first, then the pairs that they leave apart.

    In a large group of near copies nearly all pairs link; the stars join it with a few rows for each member, and the
    join of pairs then only emits links between what is still apart. The components are those of all links.
    """
    stars = components(star_pairs(entries))
    labelled = stash(entries.join(stars, F.col("id") == F.col("node"), "left").select("id", "f0", F.coalesce("component", "id").alias("label")))
    joined = components(mih_pairs(labelled).select(F.least("label", "to").alias("a"), F.greatest("label", "to").alias("b")).distinct())
    return labelled.join(joined, F.col("label") == F.col("node"), "left").select(F.col("id").alias("node"), F.coalesce("component", "label").alias("component"))


def simhash_components(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """doc_id, f0 and component_id, the smallest id reachable over links, of every row of ``docs``.

    Fingerprints are linked, not ids: rows without an id and rows that repeat one, with whatever texts, link by their
    own texts. Null and empty texts have fingerprint zero and link like any other. A component is null only if none
    of its rows has an id. An empty table gives an empty result.
    """
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marked = stash(with_columns_of(own, "f0 long", lambda texts: [[fingerprint(t, shingle) for t in texts]]))
    classes = stash(marked.groupBy("f0").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies")))
    linked = settled(docs.sparkSession, lambda: linked_components(classes.select(F.col("f0").alias("id"), "f0")))
    placed = stash(classes.join(linked, F.col("f0") == F.col("node"), "left").select("f0", "least_id", "copies", F.coalesce("component", "f0").alias("component")))
    groups = placed.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("members"))
    named = stash(join_counted(placed.select("f0", "copies", "component"), stash(groups), ["component"], "members", placed.count()).select("f0", "copies", "component_id"))
    return join_counted(marked, named, ["f0"], "copies", marked.count()).select("doc_id", "f0", "component_id")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group of near copies in ``docs``, that of the smallest id (null last), with its columns unchanged.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, all of them and no
    others. Pairs within 3 bits of SimHash come from multi-index hashing; fingerprints can't find the rest (at 0.8 they
    differ by some 10 of 64 bits, and balls complete for that meet a good part of all pairs), which a join of sorted
    prefixes adds without loss; either way the complete sets decide (``weft.llm.shingles``). Rows without an id, or
    that repeat one, are rows like others. Null and empty texts are near copies of each other.
    """
    from weft.llm.shingles import first_of_groups

    rows = stash(docs.select(as_one(docs), F.monotonically_increasing_id().alias("row_id")))
    texts = rows.select("row_id", F.col("row")[key].cast("long").alias("doc_id"), F.col("row")[text].alias("text"))
    kept = settled(docs.sparkSession, lambda: first_of_groups(texts))
    return unpacked(rows.join(kept, "row_id", "left_semi"), docs.columns, [])


def op5_simhash_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
