"""Order-sensitive clean-up of event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, by: list[str], order: str, nulls_stay: str | None = None) -> DataFrame:
    """The first row of each group; rows whose ``nulls_stay`` is null are all kept."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    keep = F.col("n") == 1 if nulls_stay is None else (F.col("n") == 1) | F.col(nulls_stay).isNull()
    return rows.withColumn("n", n).filter(keep).drop("n")


def without_echoes(rows: DataFrame, key: str, order: str, same: list[str]) -> DataFrame:
    """Without rows that equal the one just before them in all of ``same``."""
    w = Window.partitionBy(key).orderBy(order)
    echo = F.lit(True)
    for c in same:
        echo = echo & F.col(c).eqNullSafe(F.lag(c).over(w))
    return rows.withColumn("echo", echo & F.lag(F.lit(1)).over(w).isNotNull()).filter("not echo").drop("echo")


def positional_join(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """The k-th row of each key on the left with the k-th on the right; surplus rows on the left stay unmatched."""
    w = Window.partitionBy(key).orderBy(order)
    a, b = left.withColumn("k", F.row_number().over(w)), right.withColumn("k", F.row_number().over(w)).withColumnRenamed(order, f"{order}_right")
    return a.join(b, [key, "k"], "left")


def credit_forward(rows: DataFrame, key: str, order: str, owner: Column, amount: str) -> DataFrame:
    """(key, owner_no, amount): amounts go to the next owner row, what trails the last owner goes to it."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.coalesce(F.sum(owner.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    owners = F.sum(owner.cast("int")).over(Window.partitionBy(key))
    return rows.withColumn("owner_no", F.least(before, owners - 1)).filter(F.col("owner_no") >= 0).groupBy(key, "owner_no").agg(F.sum(amount).alias(amount))


def first_example(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """(by, example, same): the first value of each group and how many rows share it."""
    first = rows.groupBy(*by).agg(F.min_by(value, order).alias("example"))
    return rows.join(first, by).groupBy(*by, "example").agg(F.count_if(F.col(value).eqNullSafe(F.col("example"))).alias("same"))


def merge_order(rows: DataFrame, time: str, *ties: str) -> DataFrame:
    """Timed rows first by time, then the others, ties by the given columns."""
    return rows.orderBy(F.asc_nulls_last(time), *ties)
