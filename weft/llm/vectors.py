"""Embedding near-duplicates by an exact metric range join.

Vectors of unit length form a metric space under the angle between them, and a cosine of 0.95 or more is an angle of at
most ``reach``. Pivots (some distinct vectors) partition the space into cells of nearest pivots. For a pair across two
cells the triangle inequality bounds how near the border both lie, so a vector only visits the cells

    angle(x, p_j) - angle(x, p_own) <= 2 reach,   angle(x, p_j) <= radius_j + reach,

and whose bisector plane lies within reach of it. A pair is looked for in the cell of the lower number. Cells are cut
into blocks of owners, and the visitors of a cell, counted first, are dealt into as many chunks as they fill, so a task
compares a bounded number of vectors with matrix products; it emits counts per vector and a star for each local
component instead of pairs. Owners are copied once for each chunk of visitors that their own cell has.

Equal vectors are one entry with a count, so thousands of copies cost one row. Vectors without structure (hundreds of
random dimensions) are near no border-free cell: any exact method then compares most pairs, and so does this one.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import settled, stash, table
from weft.llm.graph import components, join_counted

#: Rows of a block of owners and of a chunk of visitors, and pivots at most (a default).
BLOCK, CHUNK, MOST_PIVOTS = 4096, 16384, 1024


def usable(v: Column) -> Column:
    """No null, no null or non-finite component, not zero."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~odd & F.exists(v, lambda x: x != 0)


def unit(rows: list) -> np.ndarray:
    x = np.array([np.asarray(r, np.float64) for r in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)  # keeps squares in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def stars(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(members, smallest id of each one's component) of the graph with edges between positions ``a`` and ``b``."""
    label = ids.copy()
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if (label == before).all():
            break
    member = np.unique(np.concatenate([a, b]))
    return ids[member], label[member]


def compare(owners: pd.DataFrame, visitors: pd.DataFrame, among_owners: bool, cosine: float) -> pd.DataFrame:
    """id, links (weighted by copies) and peer of vectors that link; ``peer`` is the smallest of a local component."""
    everyone = pd.concat([owners, visitors], ignore_index=True)
    if everyone.empty:
        return pd.DataFrame({"id": [], "links": [], "peer": []}).astype("int64")
    x = unit(everyone["embedding"].tolist())
    quick, n = x.astype(np.float32), len(owners)
    ids, copies = everyone["id"].to_numpy(), everyone["copies"].to_numpy()
    links, member, peer = np.zeros(len(ids), np.int64), [], []
    for at in range(0, n, 256):
        end = min(at + 256, n)
        first = at if among_owners else n
        a, b = np.nonzero(quick[at:end] @ quick[first:].T >= cosine - 1e-4)
        a, b = a + at, b + first
        a, b = a[a < b], b[a < b]
        exact = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)]) >= cosine
        a, b = a[exact], b[exact]
        if len(a):
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            m, p = stars(ids, a, b)
            member.append(m)
            peer.append(p)
    if not member:
        return pd.DataFrame({"id": [], "links": [], "peer": []}).astype("int64")
    edges = pd.DataFrame({"id": np.concatenate(member), "peer": np.concatenate(peer)}).drop_duplicates()
    linked = np.flatnonzero(links)
    return pd.concat([edges.assign(links=0), pd.DataFrame({"id": ids[linked], "links": links[linked], "peer": ids[linked]})], ignore_index=True)[["id", "links", "peer"]]


def range_join(entries: DataFrame, cosine: float = 0.95, vectors_per_pivot: int = 4096, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """(id, links, peer) rows: links add up per id, and (id, peer) are edges of the link graph's components.

    ``entries`` has distinct ids, h (a hash, which picks the pivots), copies and usable embeddings of one length.
    ``most_pivots`` bounds what the driver holds; with fewer pivots cells are larger, the links are the same.
    """
    spark = entries.sparkSession
    total = entries.count()
    n_pivots = min(most_pivots, max(1, math.ceil(total / vectors_per_pivot)))
    pivots = unit([r["embedding"] for r in entries.orderBy("h").limit(n_pivots).collect()] or [[1.0]])
    reach = math.acos(cosine)
    between = np.sqrt(np.maximum(((pivots[:, None] - pivots[None]) ** 2).sum(axis=2), 1e-30))

    def place(batches):
        for batch in batches:
            if len(batch):
                near = unit(batch["embedding"].tolist()) @ pivots.T
                cell = near.argmax(axis=1)
                yield batch.assign(cell=cell.astype(np.int32), angle=np.arccos(np.clip(near.max(axis=1), -1, 1)))

    kind = entries.schema["embedding"].dataType.simpleString()
    placed = stash(entries.select("id", "copies", "embedding").mapInPandas(place, f"id long, copies long, embedding {kind}, cell int, angle double"))
    cells = {r["cell"]: (r["n"], r["radius"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}  # one row for each pivot
    size = min(BLOCK, max(512, total // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    blocks = np.array([math.ceil(cells.get(c, (0, 0))[0] / size) for c in range(len(pivots))])
    radius = np.array([cells.get(c, (0, -10.0))[1] for c in range(len(pivots))])

    def visits(batch: pd.DataFrame) -> np.ndarray:
        """Whether each vector visits each cell other than its own."""
        near = unit(batch["embedding"].tolist()) @ pivots.T
        angle, cell = np.arccos(np.clip(near, -1, 1)), batch["cell"].to_numpy()
        row, slack = np.arange(len(batch)), 1e-7
        plane = (near[row, cell][:, None] - near) / between[cell]
        close = (angle - angle[row, cell][:, None] <= 2 * reach + slack) & (angle <= radius + reach + slack)
        return close & (plane <= 2 * math.sin(reach / 2) + slack) & (np.arange(len(pivots)) < cell[:, None])

    def count(batches):
        n = np.zeros(len(pivots), np.int64)
        for batch in batches:
            if len(batch):
                n += visits(batch).sum(axis=0)
        yield pd.DataFrame({"cell": np.arange(len(pivots), dtype=np.int32), "n": n})

    visited = {r["cell"]: r["n"] for r in placed.select("embedding", "cell").mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # one row for each pivot
    # members of a cell also visit the blocks of their own cell that come before theirs
    chunks = np.array([max(1, math.ceil((visited.get(c, 0) + cells.get(c, (0, 0))[0]) / CHUNK)) for c in range(len(pivots))])
    first_task = np.cumsum(blocks * chunks) - blocks * chunks

    def deal(batches):
        for batch in batches:
            if not len(batch):
                continue
            goes, cell, ids = visits(batch), batch["cell"].to_numpy(), batch["id"].to_numpy().astype(np.uint64)
            mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            block, spread = (mixed >> np.uint64(40)).astype(np.int64) % blocks[cell], mixed >> np.uint64(8) & np.uint64(0xFFFFFFFF)
            row, task, owner = [], [], []
            for j in np.unique(cell).tolist():
                at = np.flatnonzero(cell == j)
                for c in range(chunks[j]):  # owners meet every chunk of their cell's visitors
                    row.append(at)
                    task.append(first_task[j] + block[at] * chunks[j] + c)
                    owner.append(np.ones(len(at), bool))
            for j in range(len(pivots)):
                for k in range(blocks[j]):
                    at = np.flatnonzero(goes[:, j] | (cell == j) & (k < block))
                    row.append(at)
                    task.append(first_task[j] + k * chunks[j] + spread[at].astype(np.int64) % chunks[j])
                    owner.append(np.zeros(len(at), bool))
            row, task, owner = np.concatenate(row), np.concatenate(task), np.concatenate(owner)
            for i in range(0, len(row), 20_000):
                part = batch.iloc[row[i : i + 20_000]]
                yield pd.DataFrame({"task": task[i : i + 20_000], "owner": owner[i : i + 20_000], "id": part["id"].values, "copies": part["copies"].values, "embedding": part["embedding"].values})

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        cell = np.searchsorted(first_task, key[0], "right") - 1
        first_chunk = (key[0] - first_task[cell]) % chunks[cell] == 0  # there the owners also meet each other
        return compare(rows[rows["owner"]], rows[~rows["owner"]], first_chunk, cosine)

    dealt = placed.mapInPandas(deal, f"task long, owner boolean, id long, copies long, embedding {kind}")
    return dealt.groupBy("task").applyInPandas(meet, "id long, links long, peer long")


def near_vectors(vectors: DataFrame, cosine: float = 0.95, key: str = "vec_id", embedding: str = "embedding", vectors_per_pivot: int = 4096) -> DataFrame:
    """vec_id, n_links (other vectors at ``cosine`` or more), component_id and kept of every row of ``vectors``.

    Vectors that are null, empty or zero, or hold null or non-finite components link with nothing and are their own
    component. Vectors of different lengths have no cosine and don't link; those of each length are joined by a range
    join of their own. Equal vectors link. Vectors are linked, not ids:
    a row without an id, or that repeats one, links by its own vector, and a component is named by the least id in it,
    null if it has none. An empty table gives an empty result.
    """
    v = F.col(embedding)
    rows = stash(vectors.select(F.col(key).cast("long").alias("vec_id"), F.when(usable(v), v).alias("embedding")).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")}))
    fits = F.col("embedding").isNotNull()
    grouped = rows.filter(fits).groupBy("h1", "h2").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding"))
    classes = stash(grouped.withColumn("id", F.monotonically_increasing_id()))
    n = F.size("embedding")
    lengths = [r["n"] for r in classes.select(n.alias("n")).distinct().orderBy("n").collect()]  # mostly one
    own = classes.select("id", F.col("h1").alias("h"), "copies", "embedding")
    joined = [settled(vectors.sparkSession, lambda k=k: range_join(own.filter(n == k), cosine, vectors_per_pivot)) for k in lengths]
    met = reduce(DataFrame.unionByName, joined or [vectors.sparkSession.createDataFrame([], "id long, links long, peer long")])
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    named = components(met.select(F.col("id").alias("a"), F.col("peer").alias("b")))
    placed = classes.drop("embedding").join(links, "id", "left").join(named, F.col("id") == F.col("node"), "left")
    placed = stash(placed.select("h1", "h2", "copies", "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")))
    groups = stash(placed.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("members")))
    known = stash(join_counted(placed.select("h1", "h2", "copies", "n_links", "component"), groups, ["component"], "members", placed.count()).select("h1", "h2", "copies", "n_links", "component_id"))
    slim = rows.select("vec_id", "h1", "h2", fits.alias("fits"))
    found = join_counted(slim.filter("fits"), known, ["h1", "h2"], "copies", rows.count()).select("vec_id", "n_links", "component_id")
    alone = slim.filter(~F.coalesce("fits", F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
