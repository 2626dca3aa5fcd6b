"""All pairs of documents whose sets of word shingles have a Jaccard similarity of 0.8 or more, exactly.

Sets of similarity 0.8 share four fifths of the larger one. So if every set is sorted by one order, whichever it is, the
first ``size // 5 + 1`` shingles of both have one in common: the join on these prefixes loses no pair. Of two sizes known,
both must share 4/9 of their sum, so the first they share has at least as many from it to either end (``_reaches``). The
order puts shingles seen often last, which keeps passages that many documents quote out of the prefixes. SimHash pairs are
candidates beside those of the prefixes. Every candidate is verified by the intersection of the complete sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import collected, dealt, settled, stash, task_of, text_slices, with_columns_of
from weft.llm.graph import components
from weft.llm.simhash import majority, mih_pairs, star_pairs

SEED, SHINGLE, BUCKETS = 42, 5, 1 << 20
#: Rounds of stars, and representatives that an entry is compared with in each.
ROUNDS, RAYS = 3, 2
#: Bits of a set's parities.
PARITY = 256
MOST_IDS = 1_000_000


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; a text of fewer words is one shingle, an empty one has none."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.int64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    size = min(SHINGLE, len(tokens))
    first = [0, *(ends[: len(tokens) - size] + 1).tolist()]
    return np.unique(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first, ends[size - 1 :].tolist(), strict=True)], np.uint64).view(np.int64))


def _common(docs: DataFrame) -> np.ndarray:
    """A level for each of BUCKETS hash intervals, higher where some shingle is seen in many documents.

    Any levels are right, they only decide how many candidates there are; so shingles count that a batch has twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches):
            found, n = np.unique(np.concatenate([np.zeros(0, np.int64), *map(shingles, texts)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([found[n > 1], n[n > 1]], ["shingle", "n"])

    counted = dealt(docs).select("text").mapInArrow(task_of(run), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    tops = counted.groupBy(F.col("shingle").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).agg(F.max("n").alias("n")).toArrow()  # at most BUCKETS rows
    levels = np.zeros(BUCKETS, np.uint8)
    levels[tops["bucket"].to_numpy()] = 4 * np.log2(tops["n"].to_numpy())
    return levels


def parities(own: np.ndarray) -> np.ndarray:
    """Whether each of PARITY intervals of hashes holds an odd number of a set's shingles, as bits of whole numbers.

    What two sets share cancels out, so they differ by at least as many shingles as their parities differ by bits.
    """
    odd = np.bincount(own & PARITY - 1, minlength=PARITY).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _marked(rows: DataFrame) -> DataFrame:
    """row_id, doc_id, s0 and s1 (a hash of the set), n (its size), f0 (its SimHash), odd (its parities) and prefix of
    (row_id, doc_id, text)."""
    levels = rows.sparkSession.sparkContext.broadcast(_common(rows))

    def compute(texts: list[str | None]) -> list:
        from xxhash import xxh3_128_digest

        sets = [shingles(t) for t in texts]
        sums = np.frombuffer(b"".join(xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
        prefixes = [s[np.argsort(levels.value[s & BUCKETS - 1], kind="stable")[: len(s) // 5 + 1]] for s in sets]
        return [sums[:, 0], sums[:, 1], [len(s) for s in sets], [majority(s.view(np.uint64)) for s in sets], [parities(s) for s in sets], prefixes]

    return with_columns_of(rows, "s0 long, s1 long, n int, f0 long, odd array<long>, prefix array<long>", compute)


def _reaches(n: Column, at: Column, other: Column) -> Column:
    """Whether a set of ``n`` has enough shingles from place ``at`` on for a similarity of 0.8 to a set of ``other``.

    The first shingle that two such sets share passes in both, as what they share lies behind it.
    """
    return 9 * (n - at) >= 4 * (n + other)


def _near(x: str, y: str) -> Column:
    """Whether sizes and parities (x.n, x.odd0, ... and y's) leave a similarity of 0.8 possible."""
    apart = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"{x}.odd{i}").bitwiseXOR(F.col(f"{y}.odd{i}"))) for i in range(PARITY // 64)))
    return (5 * F.least(f"{x}.n", f"{y}.n") >= 4 * F.greatest(f"{x}.n", f"{y}.n")) & (9 * apart <= F.col(f"{x}.n") + F.col(f"{y}.n"))


def _with_parities(entries: DataFrame) -> DataFrame:
    return entries.select("id", "n", *(F.get("odd", F.lit(i)).alias(f"odd{i}") for i in range(PARITY // 64)))


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of 0.8 or more: an intersection of 4/9 of both sizes."""
    return settled(rows.sparkSession, lambda: _verified_of(pairs, rows))


def _verified_of(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Texts travel, not their sets, which are more than twice as large; a set that the next pair needs again is kept."""
    pairs = stash(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ids = stash(pairs.select(F.explode(F.array("a", "b")).alias("row_id")).distinct())
    # counted first: up to MOST_IDS ids (8 MB) go to the texts, else texts and ids meet by an exchange
    picked = rows.select("row_id", "text").join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, "row_id")
    both = pairs.join(picked.select(F.col("row_id").alias("a"), F.col("text").alias("x")), "a").join(picked.select(F.col("row_id").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for part, texts in text_slices(batches, "x"):
            good = []
            for b, x, y in zip(part.column("b").to_pylist(), texts, part.column("y"), strict=True):
                if last[0] != b:
                    last = b, shingles(y.as_py())
                own, other = shingles(x), last[1]
                common = len(np.intersect1d(own, other, assume_unique=True)) if 5 * min(len(own), len(other)) >= 4 * max(len(own), len(other)) else 0
                good.append(9 * common >= 4 * (len(own) + len(other)))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return dealt(both).mapInArrow(task_of(run), "a long, b long")


def _rays(shared: DataFrame, turn: int) -> DataFrame:
    """(a, b): each entry of (key, id, n, at, label, central) with the RAYS representatives of other labels that it meets at
    most keys. The first turn has the most central entry of each key among them."""
    order = F.xxhash64("id", F.lit(turn))
    own = F.struct("id", "label", "n", "at")
    chosen = shared.groupBy("key").agg(F.min_by(own, order).alias("low"), F.max_by(own, order if turn else F.struct("central", "id")).alias("high"))
    # an entry meets two representatives for each of its keys
    to = F.col("to.n"), F.col("to.at")
    met = shared.join(chosen, "key").select("id", "n", "at", "label", F.explode(F.array("low", "high")).alias("to")).filter("label <> to.label").filter(_reaches(F.col("n"), F.col("at"), to[0]) & _reaches(*to, F.col("n")))
    counted = met.groupBy("id", F.col("to.id").alias("to")).agg(F.count("*").alias("c"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("c", "to")), asc=False), 1, RAYS)
    return counted.groupBy("id").agg(best.alias("best")).select(F.col("id").alias("a"), F.explode("best").alias("b")).select("a", "b.to").toDF("a", "b")


def similar_links(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, component) of the links among ``entries`` (id, n, f0, odd, prefix): every entry is there.

    Stars first, in ROUNDS: at each prefix shingle two of its entries represent it, other ones in each round, and every
    entry is compared with the RAYS representatives that it shares most of its prefix with. In the first round one of the
    two is the entry whose prefix others share most: copies with changes of their own resemble what they were made of more
    than each other. So a large group of near copies joins by a few comparisons for each of its members. Then come the
    pairs of fingerprints and the pairs of a prefix shingle that the stars leave apart, where rows of the label most
    frequent at the shingle don't meet each other. Of these, pairs go on whose places in the prefixes, sizes and parities
    leave a similarity of 0.8 possible.
    """
    # nearly all keys are of one row, so counting them apart would shuffle the prefixes twice; two numbers go as one
    stored = entries.select("id", "n", F.posexplode("prefix").alias("at", "key")).select("key", "id", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("at")).alias("n_at"))
    often = stored.withColumn("rows", F.count("*").over(Window.partitionBy("key"))).filter("rows > 1")
    parts = "key", "id", F.shiftright("n_at", 32).cast("int").alias("n"), F.col("n_at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("at"), "rows"
    shared = settled(entries.sparkSession, lambda: often.select(*parts))
    collected(entries.sparkSession)
    central = stash(shared.groupBy("id").agg((F.sum(F.log2("rows")) / F.floor(F.first("n") / 5 + 1)).alias("central")))
    labels = entries.select("id", "f0", F.col("id").alias("label"))
    for turn in range(ROUNDS):
        candidates = _rays(shared.join(labels.select("id", "label").join(central, "id"), "id"), turn)
        if not turn:
            candidates = candidates.unionByName(star_pairs(entries))
        links = _verified(candidates, rows)
        names = labels.select("id", "label")
        joined = components(links.join(names.toDF("a", "la"), "a").join(names.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
        labels = stash(labels.join(joined, F.col("label") == F.col("node"), "left").select("id", "f0", F.coalesce("component", "label").alias("label")))
        collected(entries.sparkSession)
    labelled = stash(shared.select("key", "id", "n", "at").join(labels.drop("f0"), "id"))
    mains = labelled.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("labels")).filter("labels > 1").drop("labels")
    mixed = labelled.join(mains, "key").withColumn("is_main", F.col("label") == F.col("main")).drop("main")
    mixed = stash(mixed.join(_with_parities(entries).drop("n"), "id"))
    x, y = mixed.filter("not is_main").alias("x"), mixed.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & (F.col("y.is_main") | (F.col("x.id") < F.col("y.id"))) & _reaches(*(F.col(c) for c in ("x.n", "x.at", "y.n"))) & _reaches(*(F.col(c) for c in ("y.n", "y.at", "x.n"))) & _near("x", "y"))
    one, two = (F.struct(*(F.col(f"{s}.{c}").alias(c) for c in ("id", "n", "at"))) for s in "xy")
    ordered = met.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))
    # both prefixes have one order: the shared shingles that met are the first ones, so beyond the last of them only what follows can be common
    counted = ordered.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.n").alias("an"), F.col("b.n").alias("bn")).agg(F.count("*").alias("c"), F.max("a.at").alias("i"), F.max("b.at").alias("j"))
    possible = counted.filter("9 * (c + least(an - i - 1, bn - j - 1)) >= 4 * (an + bn)").select("a", "b")
    links = _verified(possible.unionByName(mih_pairs(labels).select("a", "b")), rows)
    collected(entries.sparkSession)
    names = labels.drop("f0")
    crossing = links.join(names.toDF("a", "la"), "a").join(names.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    joined = components(crossing)
    return names.join(joined, F.col("label") == F.col("node"), "left").select("id", F.coalesce("component", "label").alias("component"))


def first_of_groups(rows: DataFrame) -> DataFrame:
    """row_id of the first row, by doc_id (null last), of each group of linked texts in (row_id, doc_id, text).

    ``row_id`` is unique and not null. Texts of equal sets are one entry from the start, so a group of copies costs one
    row.
    """
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_id")

    def distinct_sets() -> DataFrame:
        grouped = stash(_marked(rows)).groupBy("s0", "s1", "n").agg(F.min(first).alias("first"), F.any_value("f0").alias("f0"), F.any_value("odd").alias("odd"), F.any_value("prefix").alias("prefix"))
        return grouped.select(F.col("first.row_id").alias("id"), "first", "n", "f0", "odd", "prefix")

    entries = settled(rows.sparkSession, distinct_sets)
    collected(rows.sparkSession)
    linked = similar_links(entries.select("id", "n", "f0", "odd", "prefix"), rows)
    return entries.select("id", "first").join(linked, "id").groupBy("component").agg(F.min("first").alias("first")).select("first.row_id")
