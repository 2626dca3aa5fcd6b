"""Centroid clustering of integer vectors by annulus search.

Centroids are sorted by norm. For a vector at distance u of some centroid, the triangle inequality leaves only centroids
whose norm differs from the vector's by at most u: a ring that binary search cuts out of the sorted norms. u comes from
the two centroids that are nearest by norm. The candidates are then compared in whole numbers, so ties, also those on
the ring's border, go to the smaller number exactly.

A round reads the vectors once and gives back a sum and a count for each centroid and task; assignments aren't kept
between rounds. What the driver holds are the centroids: ``k`` of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import dealt, settled, small_table, stash, table, task_of

#: Components beyond this have squared distances that a long can't hold.
MOST = 1 << 27


def whole_components(v: Column, dims: int, scale: int) -> Column:
    """The components of ``v`` as floor(scale * x), null if they aren't ``dims`` finite numbers."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    too_large = F.exists(ints, lambda x: F.abs(x) > MOST)
    ints = F.when(too_large, F.raise_error(F.lit(f"a component lies beyond {MOST}: squared distances don't fit a long"))).otherwise(ints)
    return F.when(v.isNotNull() & (F.size(v) == dims) & ~odd, ints.cast("array<int>"))


def annuli(norms: np.ndarray, own: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector's norm and upper bound, the range of sorted ``norms`` that no nearer centroid lies outside of.

    Norms are rounded square roots of whole numbers; the slack keeps what lies on the border inside.
    """
    slack = 1e-9 * (own + bound + 1)
    return np.searchsorted(norms, own - bound - slack, "left"), np.searchsorted(norms, own + bound + slack, "right")


class Ring:
    """Centroids in order of norm."""

    def __init__(self, centroids: np.ndarray):
        squares = (centroids * centroids).sum(axis=1)
        self.number = np.lexsort((np.arange(len(centroids)), squares))
        self.centroids, self.norms = centroids[self.number], np.sqrt(squares[self.number].astype(np.float64))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row of ``x``; of equally near ones the smaller number."""
        own = np.sqrt((x * x).sum(axis=1).astype(np.float64))
        above = np.minimum(np.searchsorted(self.norms, own), len(self.norms) - 1)
        below = np.maximum(above - 1, 0)
        first = np.minimum(self._squared(x, above), self._squared(x, below))
        low, high = annuli(self.norms, own, np.sqrt(first.astype(np.float64)))
        best, number = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.norms))
        for j in range(int(low.min(initial=0)), int(high.max(initial=0))):
            at = np.flatnonzero((low <= j) & (j < high))
            d = ((x[at] - self.centroids[j]) ** 2).sum(axis=1)
            better = (d < best[at]) | (d == best[at]) & (self.number[j] < number[at])
            best[at[better]], number[at[better]] = d[better], self.number[j]
        return number, best

    def _squared(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((x - self.centroids[at]) ** 2).sum(axis=1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _blocks(batch: pa.RecordBatch, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """``centroids`` after a round: each the floor of its vectors' mean, or as it was without any."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring, sums, counts = Ring(centroids), np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for part in _blocks(batch):
                x = _matrix(part.column("v"), dims)
                number, _ = ring.nearest(x)
                order = np.argsort(number, kind="stable")
                found, starts = np.unique(number[order], return_index=True)
                sums[found] += np.add.reduceat(x[order], starts, axis=0)
                counts += np.bincount(number, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at]), pa.array(list(sums[at]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    part = vectors.select("v").mapInArrow(task_of(run), "cluster int, n long, sums array<long>")
    cells = part.select("cluster", "n", F.posexplode("sums").alias("at", "s"))
    whole = cells.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # k times dims rows
    out = centroids.copy()
    for r in whole:
        out[r["cluster"], r["at"]] = int(r["s"] if isinstance(r["s"], int) else Decimal(r["s"])) // r["n"]
    return out


def centroid_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2", key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of the vectors that are kept.

    Kept are vectors of exactly ``dims`` components, none null or not finite; each component becomes floor(scale * x).
    The first centroids are the ``k`` vectors with the smallest hex SHA-256 of ``seed:id``, those of equal hashes by
    their components; rows without an id come last. With fewer than ``k`` vectors there are fewer clusters. Repeated
    rows are vectors of their own and may be centroids twice, of which the second stays empty. An empty table gives an
    empty result. A component beyond 2**27 after scaling is an error, as distances wouldn't fit a long.
    """
    spark = vectors.sparkSession
    own = dealt(vectors).select(F.col(key).cast("long").alias("vec_id"), whole_components(F.col(embedding), dims, scale).alias("v"))
    kept = stash(own.filter("v is not null"))
    chosen = kept.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    centroids = np.array([r["v"] for r in chosen], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(kept, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring = Ring(centroids)
        for batch in batches:
            for part in _blocks(batch):
                number, distance = ring.nearest(_matrix(part.column("v"), dims))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    near = settled(spark, lambda: kept.mapInArrow(task_of(run), "vec_id long, cluster int, distance long"))
    sums = {r["cluster"]: r["s"] for r in near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    inertia = int(sum(sums.values()))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = small_table(spark, [(c, int(s), inertia, digests[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return near.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op13_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


_NEAR = "select vec_id, min((d, num)) as best from (select x.vec_id, c.num, list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from x, c{0} c) t group by vec_id"
_MOVE = """c{1} as materialized (select c.num, coalesce(m.v, c.v) as v from c{0} c left join (
    select num, list((s - ((s % n) + n) % n) // n order by pos) as v from (
      select a.best[2] as num, pos, cast(sum(x.v[pos]) as bigint) as s, count(*) as n from a{0} a join x using (vec_id), range(1, 65) r(pos) group by all) u group by num) m using (num))"""
_ROUNDS = ", ".join(f"a{i} as materialized ({_NEAR.format(i)}), {_MOVE.format(i, i + 1)}" for i in range(5))
#: The same in DuckDB: every vector beside every centroid.
ORACLE = f"""with x as materialized (
  select vec_id, list_transform(embedding, lambda e: cast(floor(256 * cast(e as double)) as bigint)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0
), c0 as materialized (
  select row_number() over (order by h) - 1 as num, v from (select v, sha256('2:' || vec_id) as h from x order by h limit 40) t
), {_ROUNDS}, a5 as materialized ({_NEAR.format(5)})
select vec_id, cast(best[2] as integer) as cluster, cast(best[1] as bigint) as distance, cast(sum(best[1]) over (partition by best[2]) as bigint) as cluster_inertia,
  cast(sum(best[1]) over () as bigint) as inertia, sha256(array_to_string(c5.v, ',')) as centroid_sha256 from a5 join c5 on c5.num = best[2]"""
