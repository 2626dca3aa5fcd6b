"""Clusters against whole-number loops, and rings against comparing all centroids."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import clusters

VECTORS = "vec_id long, embedding array<float>"


def brute(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * np.float64(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = sum(d for _, d, _ in found)
    return sorted((str(i), j, d, sum(e for _, e, o in found if o == j), inertia, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found)


def same(spark, rows, k=5, rounds=3, dims=4):
    vectors = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("clash") for c in ("v", "cluster", "distance", "h")}).repartition(3)
    got = clusters.centroid_clusters(vectors, k, rounds, dims).collect()
    assert sorted((str(r["vec_id"]), *r[1:]) for r in got) == brute(rows, k, rounds, dims)


def test_equals_loops(spark):
    rng = random.Random(0)
    rows = [(i, [rng.gauss(0, 1) * 10 ** rng.randint(-3, 2) for _ in range(4)]) for i in range(400)]
    same(spark, rows)
    grid = [(i, [float(rng.randint(-1, 1)) for _ in range(4)]) for i in range(300)]  # ties everywhere
    same(spark, grid, k=12, rounds=5)


def test_rows_that_are_left_out(spark):
    odd = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 2.0, 3.0]), (5, [1.0, float("nan"), 0.0, 0.0]), (6, [float("inf"), 0.0, 0.0, 0.0]), (7, [0.0] * 5)]
    good = [(8, [0.0] * 4), (9, [-0.001, 0.5, 1.0, 100.0]), (None, [1.0] * 4), (None, [2.0] * 4), (9, [-0.001, 0.5, 1.0, 100.0]), (10, [0.0] * 4)]
    same(spark, odd + good)
    same(spark, odd + good, k=40)
    same(spark, [(i % 7, [0.5] * 4) for i in range(100)])
    assert clusters.centroid_clusters(spark.createDataFrame(odd, VECTORS), dims=4).collect() == []
    assert clusters.centroid_clusters(spark.createDataFrame([], VECTORS)).collect() == []
    with pytest.raises(Exception, match="squared distances"):
        clusters.centroid_clusters(spark.createDataFrame([(1, [1e30] * 4)], VECTORS), dims=4).collect()


def test_rings_lose_no_nearest():
    rng = np.random.default_rng(0)
    for scale in (3, 300, 2**26):
        x, c = rng.integers(-scale, scale, (500, 8)), rng.integers(-scale, scale, (60, 8))
        c[10], x[:60] = c[40], c  # equal centroids, vectors on centroids
        d = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
        number, best = clusters.Ring(c).nearest(x)
        assert number.tolist() == [min(range(60), key=lambda j: (row[j], j)) for row in d] and best.tolist() == [min(row) for row in d]


def test_rings_spare_comparisons():
    rng = np.random.default_rng(1)
    c = rng.normal(size=(200, 8)) * np.arange(1, 201)[:, None] * 100
    ring = clusters.Ring(c.astype(np.int64))
    x = (c[::5] + rng.normal(size=(40, 8))).astype(np.int64)
    own = np.sqrt((x * x).sum(axis=1).astype(float))
    first = np.sqrt(ring._squared(x, np.minimum(np.searchsorted(ring.norms, own), 199)).astype(float))
    low, high = clusters.annuli(ring.norms, own, first)
    assert (high - low).mean() < 100
