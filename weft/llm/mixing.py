"""Mixing sources to target weights by entropy balancing.

The mix gives every document a rate ``r`` (expected copies) that stays as close to one epoch as possible in
relative entropy while the tokens of each source meet a target:

    minimise  sum_i r_i log r_i - r_i    subject to  sum_{i in s} size_i r_i = target_s,  0 <= r_i <= cap

The dual has one multiplier per source, and its optimum tilts rates exponentially: ``r_i = min(cap,
exp(lambda_s * size_i / mean_s))``. Documents of equal size share a rate, so Newton's method runs on a histogram
of (source, size) that Spark builds once; each iteration is one distributed aggregation that returns the dual's
gradient and curvature per source.

Rates become whole copies by systematic rounding along document size: within a source the cumulated rates, in
order of size, are cut at whole numbers. Every document gets the floor or ceiling of its rate, and the words taken
differ from the target by about one longest document, since the rounding errors alternate along a monotone size.
The cumulation is spread: each size class of a source of n documents is cut into sqrt(n) buckets.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from weft.llm.common import as_one, computed_once, n_words, small_table, stash, table, unpacked

#: Rates are kept as whole multiples of 2**-UNIT, so cumulation is exact and reruns agree.
UNIT = 20
#: Size classes per doubling of the size.
CLASSES = 4


def ordered(kind: DataType) -> bool:
    """Whether values of a type can be hashed: neither maps nor variants, nor anything that holds one."""
    if isinstance(kind, ArrayType):
        return ordered(kind.elementType)
    if isinstance(kind, StructType):
        return all(ordered(f.dataType) for f in kind.fields)
    return not isinstance(kind, MapType | VariantType)


def water_fill(sizes: list[int], weights: list[int], share: Fraction, cap: int) -> list[float]:
    """Targets by weight for ``share`` of all sizes; none above ``cap`` times its size, the excess reshared."""
    left, weight, out = share * sum(sizes), sum(weights), [0.0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: Fraction(cap * sizes[i], weights[i])):
        target = min(Fraction(cap * sizes[i]), left * weights[i] / weight)
        out[i], left, weight = float(target), left - target, weight - weights[i]
    return out


def _solve(spark: SparkSession, hist: DataFrame, sources: list[dict], cap: int) -> None:
    """Set ``tilt`` of each source (None: every rate is the cap) by safeguarded Newton steps on the dual.

    Each step either lands nearer or halves the interval, and a multiplier that no longer moves is done.
    """
    open_ = []
    for s in sources:
        s["tilt"] = 0.0
        if s["target"] >= cap * s["size"] * (1 - 1e-12):
            s["tilt"] = None
        elif s["target"] > 0:
            # at most one word a document: beyond these multipliers all rates are capped, or below target / size
            s["low"], s["high"] = min(0.0, math.log(s["target"] / s["size"])) * s["mean"] - 1, math.log(cap) * s["mean"] + 1
            open_.append(s)
    while open_:
        state = small_table(spark, [(s["sid"], s["tilt"], s["mean"]) for s in open_], "sid int, tilt double, mean double")
        z = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(cap)), F.exp(F.col("tilt") * z))
        words = F.col("n") * F.col("size") * rate
        exact = lambda c: F.sum(c.cast("decimal(30,6)"))  # noqa: E731  decimal sums don't depend on the order of tasks
        at = {r["sid"]: r for r in hist.join(F.broadcast(state), "sid").groupBy("sid").agg(exact(words).alias("f"), exact(F.when(rate < cap, words * z).otherwise(0)).alias("g")).collect()}
        going = []
        for s in open_:
            f, g, target = float(at[s["sid"]]["f"]), float(at[s["sid"]]["g"]), s["target"]
            if abs(f - target) <= max(0.25, 1e-9 * target):
                continue
            s["low" if f < target else "high"] = s["tilt"]
            step = None if g <= 0 else (f - target) / g if f > target else f * math.log(f / target) / g if f > 0 else None
            tilt = s["tilt"] - step if step is not None else math.inf
            if not s["low"] < tilt < s["high"]:
                tilt = (s["low"] + s["high"]) / 2
            if abs(tilt - s["tilt"]) > 1e-13 * max(1.0, abs(tilt)):
                s["tilt"] = tilt
                going.append(s)
        open_ = going


def entropy_mix(docs: DataFrame, size: str = "size", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), cap: int = 2, max_sources: int = 100_000) -> DataFrame:
    """All rows and columns of ``docs`` with source_size, target, rate and copies (0 to ``cap``).

    Sources in order of code points, null last, take ``weights`` in turn. Documents of size 0 (or null) hold
    nothing to take: rate and copies are 0. A null key or source is a value like any other; repeated rows are
    separate documents, and rows are ordered by all their columns (but maps and variants) where size and key agree. An empty table gives an
    empty result. ``max_sources`` bounds what the driver and broadcasts hold, one entry for each source; more sources
    raise an error. Added columns replace columns of the same name.
    """
    spark = docs.sparkSession
    rows = docs.select(as_one(docs), F.col(source).cast("string").alias("src"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("words"), F.xxhash64(F.col(key), *(F.col(f"`{c}`") for c in docs.columns if ordered(docs.schema[c].dataType))).alias("h"))
    hist = stash(rows.groupBy("src", F.col("words").alias("size")).agg(F.count("*").alias("n")))
    totals = hist.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n"), F.sum("n").alias("docs")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources; name fewer groups")
    sources = [{"src": r["src"], "size": r["size"], "mean": r["size"] / max(1, r["n"]), "docs": r["docs"]} for r in sorted(totals, key=lambda r: (r["src"] is None, r["src"] or ""))]
    for i, (s, target) in enumerate(zip(sources, water_fill([s["size"] for s in sources], [weights[i % len(weights)] for i in range(len(sources))], share, cap), strict=True)):
        s |= {"sid": i, "target": target}
    known = small_table(spark, [(s["src"], s["sid"]) for s in sources], "src string, sid int")
    hist = hist.filter("size > 0").join(F.broadcast(known), hist["src"].eqNullSafe(known["src"])).select("sid", "size", "n")
    _solve(spark, hist, sources, cap)

    solved = small_table(spark, [(s["src"], s["sid"], s["size"], s["target"], s["tilt"], s["mean"], math.isqrt(s["docs"]) + 1) for s in sources], "known_src string, sid int, source_size long, target double, tilt double, mean double, buckets long")
    rate = F.when((F.col("words") <= 0) | (F.col("target") <= 0), 0.0).when(F.col("tilt").isNull(), float(cap)).otherwise(F.least(F.lit(float(cap)), F.exp(F.col("tilt") * F.col("words") / F.col("mean"))))
    size_class = F.when(F.col("words") > 0, F.floor(F.log2(F.col("words").cast("double")) * CLASSES).cast("int")).otherwise(-1)
    rated = rows.join(F.broadcast(solved), F.col("src").eqNullSafe(F.col("known_src"))).withColumn("rate", rate)
    rated = rated.withColumns({"q": F.round(F.col("rate") * 2**UNIT).cast("long"), "class": size_class, "bucket": F.pmod("h", F.col("buckets"))})
    bucket = ["sid", "class", "bucket"]
    # about sqrt(documents) rows for each class of a source
    ahead = Window.partitionBy("sid").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rated.groupBy(*bucket).agg(F.sum("q").alias("bucket_q")).withColumn("start", F.coalesce(F.sum("bucket_q").over(ahead), F.lit(0))).drop("bucket_q")
    within = Window.partitionBy(*bucket).orderBy("words", F.xxhash64("row." + key), "row." + key, "h").rowsBetween(Window.unboundedPreceding, 0)
    placed = rated.withColumn("upto", F.sum("q").over(within)).join(starts, bucket)
    upto = F.col("start") + F.col("upto") + 2 ** (UNIT - 1)
    copies = F.shiftright(upto, UNIT) - F.shiftright(upto - F.col("q"), UNIT)
    return unpacked(placed.withColumn("copies", copies.cast("int")), docs.columns, ["source_size", "target", "rate", "copies"])


def repeat_copies(mixed: DataFrame) -> DataFrame:
    """One row for each of the ``copies`` of a row, without that column; documents without a copy go."""
    own = [c for c in mixed.columns if c != "copies"]
    repeated = mixed.filter("copies > 0").select(as_one(mixed), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth"))
    return unpacked(repeated, own, [])


def mixed_corpus(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their columns unchanged; sizes are words."""
    hidden = docs.select(as_one(docs, "doc"), F.col(source).alias("source"), F.col(key).alias("doc_id"), n_words(F.col(text)).alias("size"))
    return unpacked(repeat_copies(entropy_mix(hidden)), docs.columns, [], "doc")


def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = computed_once(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "size", n_words(F.col("text"))).drop("text")
    mixed = entropy_mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")
