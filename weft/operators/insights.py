"""Cross-session aggregates: facets, breakdowns, quantiles, examples, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def facets(rows: DataFrame, columns: list[str], most: int = 6) -> DataFrame:
    """(facet, value, n, r): the most frequent values of each column, in one pass over the rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    n = rows.select(pairs.alias("p")).select("p.*").filter("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))
    return top(n, ["facet"], [F.desc("n"), F.asc("value")], most)


def top(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group, with r from 1."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("r") <= most)


def nearest_rank(values: DataFrame, column: str, by: list[str], quantiles: list[float]) -> DataFrame:
    """Exact nearest-rank quantiles over positive values: q50, q90, ..."""
    kept = values.filter(F.col(column) > 0)
    return kept.groupBy(*by).agg(*(F.expr(f"percentile_disc({q}) within group (order by {column})").alias(f"q{round(q * 100)}") for q in quantiles))


def histogram(values: DataFrame, column: str, edges: list[float], labels: list[str]) -> DataFrame:
    """(label, n): lower bounds belong to a class; classes without rows have 0."""
    bucket = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels, strict=False))):
        bucket = F.when(F.col(column) < edge, label).otherwise(bucket)
    n = values.filter(F.col(column).isNotNull()).groupBy(bucket.alias("label")).agg(F.count("*").alias("n"))
    every = values.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return every.join(F.broadcast(n), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def breakdown(rows: DataFrame, groups: list[str]) -> DataFrame:
    """(grouping, value, sessions, error_sessions, calls, errors, rate) for each of ``groups``, one shuffle for all."""
    sets = rows.groupingSets([[F.col(g)] for g in groups], *(F.col(g) for g in groups))
    out = sets.agg(F.count("*").alias("sessions"), F.count_if(F.col("errors") > 0).alias("error_sessions"), F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.grouping_id().alias("gid"))
    which = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for i, g in enumerate(groups):
        own = (1 << len(groups)) - 1 - (1 << (len(groups) - 1 - i))
        which, value = F.when(F.col("gid") == own, g).otherwise(which), F.when(F.col("gid") == own, F.col(g).cast("string")).otherwise(value)
    return out.select(which.alias("grouping"), value.alias("value"), "sessions", "error_sessions", "calls", "errors", F.when(F.col("calls") > 0, F.col("errors") / F.col("calls")).otherwise(0.0).alias("rate"))


def compare(counts: DataFrame, key: str, left, right, item: str = "tool") -> DataFrame:
    """(item, n_left, n_right, delta, noise) of two sessions; a delta under 5 % of the larger side is noise."""
    a = counts.filter(F.col(key) == left).select(item, F.col("n").alias("n_left"))
    b = counts.filter(F.col(key) == right).select(item, F.col("n").alias("n_right"))
    both = a.join(b, item, "full_outer").select(item, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    delta = F.col("n_right") - F.col("n_left")
    return both.withColumns({"delta": delta, "noise": F.abs(delta) < 0.05 * F.greatest("n_left", "n_right")})


def ranked(rows: DataFrame, column: str, ascending: bool = False, tie: str = "path") -> DataFrame:
    """Sorted by ``column``, descending unless asked otherwise; ascending puts zeros last."""
    c = F.coalesce(F.col(column), F.lit(0))
    return rows.orderBy(F.when(c == 0, 1).otherwise(0), c.asc(), tie) if ascending else rows.orderBy(c.desc(), tie)


def page(rows: DataFrame, number: int, size: int = 50) -> DataFrame:
    """One page of sorted rows; numbers and sizes out of range are moved into it."""
    size = max(1, min(200, size))
    pages = max(1, -(-rows.count() // size))
    return rows.offset((max(1, min(pages, number)) - 1) * size).limit(size)


def global_stats(rows: DataFrame, sums: list[str], facets_of: list[str], lists: list[str] = ()) -> DataFrame:
    """(name, value, n): sums over all rows, sessions with errors, and how many rows have each value of the facets.

    ``lists`` are array columns, each of whose values counts. One pass: rows become (name, value, n) and add up.
    """
    entry = lambda name, value, n: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"), n.cast("double").alias("n"))
    none, one = F.lit(None), F.lit(1)
    fixed = F.array(
        entry("sessions", none, one), entry("error_sessions", none, (F.coalesce(F.col("errors"), F.lit(0)) > 0).cast("int")), *(entry(c, none, F.coalesce(F.col(c), F.lit(0))) for c in sums), *(entry(c, F.col(c), one) for c in facets_of),
    )
    each = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: entry(c, v, one))
    more = [each(c) for c in lists]
    long = rows.select(F.explode(F.concat(fixed, *more) if more else fixed).alias("e")).select("e.*")
    counted = long.filter(~F.col("name").isin(*facets_of) | F.col("value").isNotNull()).groupBy("name", "value").agg(F.sum("n").alias("n"))
    return counted
