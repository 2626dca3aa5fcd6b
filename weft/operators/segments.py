"""A search index in segments: batches add small ones, tiers of them are merged, deletions are tombstones.

A segment is what a batch brought: postings (key, term, tf), documents (key, dl, version, gone). ``fan`` segments of a
level become one of the next, so after N batches there are at most ``(fan - 1) * log(N)`` and a document is rewritten
once for each level. Which segments count is a small table with a version for each batch; it is written last, so
readers see the index before a batch or after it, and a batch that runs again replaces what it wrote.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.search import counted_rows, sorted_by

MANIFEST = "segment string, level int, number long"
#: So many keys at most are broadcast to drop postings where they stand.
MOST_KEYS = 1 << 20


class Segments:
    """The index below ``folder``. ``key`` names documents, ``version`` orders their states, ``gone`` marks deletions."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id", text: str = "text", version: str = "mtime", gone: str = "gone", fan: int = 4):
        self.spark, self.folder, self.key, self.text, self.version, self.gone, self.fan = spark, folder, key, text, version, gone, fan

    def _path(self, folder: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        """Batches whose manifest is whole."""
        path, store = self._path(f"{self.folder}/manifest")
        if not store.exists(path):
            return []
        listed = [s.getPath().getName() for s in store.listStatus(path)]
        return sorted(int(n) for n in listed if n.isdigit() and store.exists(self._path(f"{self.folder}/manifest/{n}/_SUCCESS")[0]))

    def manifest(self, before: int | None = None) -> list[tuple[str, int, int]]:
        """(segment, level, number) as of the newest batch (before ``before``), oldest first; number is the newest batch in it."""
        known = [v for v in self._versions() if before is None or v < before]
        if not known:
            return []
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/{known[-1]:012d}").collect()  # one row for each segment
        return sorted((tuple(r) for r in rows), key=lambda r: r[2])

    def _table(self, segments: list[tuple[str, int, int]], name: str) -> DataFrame:
        read = (self.spark.read.parquet(f"{self.folder}/{s}/{name}").drop("row", "of").withColumn("number", F.lit(n).cast("long")) for s, _, n in segments)
        return reduce(DataFrame.unionByName, read)

    def _newest(self, segments: list[tuple[str, int, int]]) -> DataFrame:
        """The newest state of each document: by version, then by segment."""
        docs = self._table(segments, "documents")
        return docs.groupBy(self.key).agg(F.max_by(F.struct("dl", self.version, self.gone, "number"), F.struct(self.version, "number")).alias("row")).select(self.key, "row.*")

    def _postings(self, segments: list[tuple[str, int, int]], newest: DataFrame) -> DataFrame:
        alive = newest.select(self.key, "number")
        return self._table(segments, "postings").join(alive, [self.key, "number"], "left_semi").select(self.key, "term", "tf")

    def add(self, batch: DataFrame, number: int) -> None:
        """A batch of (key, text, version, gone) rows, for ``foreachBatch``. Of a key's rows the newest counts; a null
        ``gone`` is false, and rows without a key are no documents. Versions may come out of order: an older one than the index has changes nothing, of a document
        that is gone as long as its tombstone isn't in the oldest segment."""
        rows = batch.filter(F.col(self.key).isNotNull()).withColumn(self.gone, F.coalesce(F.col(self.gone), F.lit(False))).withColumn("hash", F.xxhash64(self.text))
        alive = rows.withColumn(self.text, F.when(~F.col(self.gone), F.col(self.text)))
        name = f"b{number:012d}"
        # the batch is read once, texts stay where they are, and what is needed of a key's rows follows from their counts
        counted_rows(alive, self.key, self.text, self.version, self.gone, "hash").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{name}/counted")
        counts = self.spark.read.parquet(f"{self.folder}/{name}/counted")
        states = counts.filter("hash is not null")
        newest = states.groupBy(self.key).agg(F.max(F.struct(self.version, "hash", self.gone, "row", F.col("tf").alias("dl"))).alias("n")).select(self.key, "n.*")
        newest.select(self.key, self.version, self.gone, "dl", "row").write.mode("overwrite").parquet(f"{self.folder}/{name}/documents")
        newest = self.spark.read.parquet(f"{self.folder}/{name}/documents")
        terms = counts.filter("term is not null")
        if newest.count() < states.count():
            terms = terms.join(newest.select("row"), "row", "left_semi")
        sorted_by(terms.select(self.key, "term", "tf"), "term", self.key).write.mode("overwrite").parquet(f"{self.folder}/{name}/postings")
        self._delete([f"{name}/counted"])
        self._commit([*self.manifest(number), (name, 0, number)], number)

    def _commit(self, segments: list[tuple[str, int, int]], number: int) -> None:
        parts: dict[str, list] = {}  # what is merged; a level that fills by it is merged in one go
        while True:
            full = [lv for lv in sorted({s[1] for s in segments}) if sum(s[1] == lv for s in segments) >= self.fan]
            if not full:
                break
            merging = [s for s in segments if s[1] == full[0]]
            merged = (f"m{number:012d}-{full[0] + 1}", full[0] + 1, merging[-1][2])
            parts[merged[0]] = [p for s in merging for p in parts.pop(s[0], [s])]
            segments = sorted([*(s for s in segments if s[1] != full[0]), merged], key=lambda s: s[2])
        for merged in [s for s in segments if s[0] in parts]:
            # with nothing older beside it, a merged segment needs no tombstones
            self._merge(parts[merged[0]], merged[0], bool([s for s in segments if s[2] < merged[2]]))
        self.spark.createDataFrame(segments, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{number:012d}")
        self._vacuum()

    def _merge(self, segments: list[tuple[str, int, int]], name: str, tombstones: bool) -> None:
        newest = self._newest(segments)
        kept = newest if tombstones else newest.filter(~F.col(self.gone))
        kept.select(self.key, self.version, self.gone, "dl", F.col("number").alias("of")).write.mode("overwrite").parquet(f"{self.folder}/{name}/documents")
        alive = self.spark.read.parquet(f"{self.folder}/{name}/documents").filter(~F.col(self.gone)).select(self.key, F.col("of").alias("number"))
        sizes = lambda df: dict(df.groupBy("number").agg(F.count("*")).collect())  # noqa: E731, one row for each segment
        had, has = sizes(self._table(segments, "documents").filter(~F.col(self.gone))), sizes(alive)
        # segments of which nothing is left aren't read
        found = [self._left(s, alive, had[s[2]], has[s[2]]) for s in segments if has.get(s[2])]
        if len(found) == 1 and found[0][1]:
            terms = found[0][0].sortWithinPartitions("term", self.key)
        else:
            none = self._table(segments[:1], "postings").select(self.key, "term", "tf").filter(F.lit(False))
            terms = sorted_by(reduce(DataFrame.unionByName, [f for f, _ in found], none), "term", self.key)
        terms.write.mode("overwrite").parquet(f"{self.folder}/{name}/postings")

    def _left(self, segment: tuple[str, int, int], alive: DataFrame, had: int, has: int) -> tuple[DataFrame, bool]:
        """The postings of a segment's documents that are ``alive``, and whether they stand where they stood: without a
        join if that is all of them; else by the keys that are left or that aren't, whichever are fewer."""
        terms, docs = (self._table([segment], n) for n in ("postings", "documents"))
        terms, keys = terms.select(self.key, "term", "tf"), alive.filter(F.col("number") == segment[2]).select(self.key)
        if had == has:
            return terms, True
        few = min(has, had - has) <= MOST_KEYS
        if had - has < has:
            lost = docs.filter(~F.col(self.gone)).select(self.key).join(keys, self.key, "left_anti")
            return terms.join(F.broadcast(lost) if few else lost, self.key, "left_anti"), few
        return terms.join(F.broadcast(keys) if few else keys, self.key, "left_semi"), few

    def _vacuum(self, keep: int = 2) -> None:
        """Delete segments that none of the newest ``keep`` manifests names, and older manifests."""
        versions = self._versions()
        named = {s for v in versions[-keep:] for s, _, _ in self.manifest(v + 1)}
        path, store = self._path(self.folder)
        old = [s.getPath().getName() for s in store.listStatus(path)]
        self._delete([n for n in old if n[:1] in "bm" and n != "manifest" and n not in named] + [f"manifest/{v:012d}" for v in versions[:-keep]])

    def _delete(self, names: list[str]) -> None:
        for n in names:
            path, store = self._path(f"{self.folder}/{n}")
            store.delete(path, True)

    def current(self) -> tuple[DataFrame, DataFrame]:
        """(postings, lengths) of the newest version of each document that isn't gone."""
        segments = self.manifest()
        if not segments:
            raise ValueError(f"no index below {self.folder}")
        if len(segments) == 1:
            newest, terms = self._table(segments, "documents"), self._table(segments, "postings").select(self.key, "term", "tf")
        else:
            newest = self._newest(segments)
            terms = self._postings(segments, newest.filter(~F.col(self.gone)))
        return terms, newest.filter(~F.col(self.gone)).select(self.key, "dl")
