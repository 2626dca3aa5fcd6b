"""Connected components and joins that stand up to hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import settled, stash


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its smallest node.

    Labels spread to neighbours and then jump to the label of their label, so long chains shorten by halves. Each
    round is written to the shared folder. Only minima per node are shuffled, combined before the exchange.
    """
    return settled(edges.sparkSession, lambda: _labels(edges))


def _labels(edges: DataFrame) -> DataFrame:
    both = stash(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a"))).filter("u <> v").distinct())
    labels = stash(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("near"))
        lowered = stash(labels.join(near, F.col("node") == F.col("u")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        target = lowered.select(F.col("node").alias("label_node"), F.col("label").alias("further")).filter("label_node <> further")
        jumped = stash(lowered.join(target, F.col("label") == F.col("label_node"), "left").select("node", "old", F.coalesce("further", "label").alias("label")))
        labels = jumped.select("node", "label")
        if jumped.filter("old <> label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int, hot: int = 1000) -> DataFrame:
    """``left`` inner join ``right``, whose ``keys`` are unique and whose ``count`` is the left rows of a key.

    Keys with more than ``1 / hot`` of all rows, fewer than ``hot`` of them, are broadcast; no task of the exchange
    for the others gets a key with a larger share.
    """
    heavy = right.filter(F.col(count) * hot > total)
    light = right.filter(F.col(count) * hot <= total)
    is_heavy = heavy.select(*keys, F.lit(True).alias("is_heavy"))
    marked = left.join(F.broadcast(is_heavy), keys, "left")
    rest = marked.filter("is_heavy is null").drop("is_heavy")
    return left.join(F.broadcast(heavy), keys).unionByName(rest.join(light, keys))
