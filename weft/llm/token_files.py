"""Token files of patched frame-of-reference blocks.

A file holds the ids of its documents one after the other in blocks of ``BLOCK`` ids. A block stores its minimum,
then every id less the minimum in ``width`` bits, the width being the least that fits ``FIT`` percent of the block.
The ids that need more bits are patched from an exception list of (position, high bits). A footer indexes where
blocks start and how many ids each document has.

    file    magic, blocks, document ids (int64), id counts (int64), block starts (uint64), footer
    block   minimum uint32, count uint16, width uint8, exceptions uint16, packed uint64 words,
            positions uint16, high bits uint32
    footer  documents uint64, blocks uint64, bytes before the indexes uint64, null ids (bits), magic

Spark deals the documents out by ranges of doc_id, each task encodes and writes one file and moves it into place,
and the manifest (one row for each file) gives where each file's ids start among all.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.common import dealt, shared_dir, stash, store_of, table, task_of, text_slices

MAGIC, BLOCK, FIT, NO_ID = b"WPFOR001", 1024, 95, -(2**63)
MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
HEAD, FOOT = struct.Struct("<IHBH"), struct.Struct("<QQQ8s")


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """uint64 words for rows of BLOCK values below ``2**width``, 64 values in ``width`` words."""
    lanes = values.reshape(-1, BLOCK // 64, 64).astype(np.uint64)
    out = np.zeros((*lanes.shape[:2], width), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        if width:
            out[..., word] |= lanes[..., i] << np.uint64(shift)
            if shift + width > 64:
                out[..., word + 1] |= lanes[..., i] >> np.uint64(64 - shift)
    return out.reshape(len(lanes), -1)


def unpack_bits(words: np.ndarray, width: int) -> np.ndarray:
    words = words.reshape(len(words), BLOCK // 64, width)
    out = np.zeros((*words.shape[:2], 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        if width:
            got = words[..., word] >> np.uint64(shift)
            if shift + width > 64:
                got = got | words[..., word + 1] << np.uint64(64 - shift)
            out[..., i] = got & mask
    return out.reshape(len(words), BLOCK)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """One string for each BLOCK ids; the last block may hold fewer."""
    n = -(-len(ids) // BLOCK)
    padded = np.full(n * BLOCK, ids[-1] if len(ids) else 0, np.uint32)
    padded[: len(ids)] = ids
    rows = padded.reshape(n, BLOCK)
    least = rows.min(axis=1)
    rest = rows - least[:, None]
    # the FIT percentile of the values has the FIT percentile of the widths
    common = np.partition(rest, BLOCK * FIT // 100 - 1, axis=1)[:, BLOCK * FIT // 100 - 1]
    widths = np.ceil(np.log2(common.astype(np.float64) + 1)).astype(np.int64)
    out: list[bytes] = [b""] * n
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        own = rest[at]
        words = pack_bits(own & np.uint32((1 << width) - 1), width).astype("<u8")
        over = own >> np.uint32(width) if width < 32 else np.zeros_like(own)
        row, position = np.nonzero(over)
        cuts, high = np.searchsorted(row, np.arange(len(at) + 1)), over[row, position].astype("<u4")
        position = position.astype("<u2")
        for k, b in enumerate(at.tolist()):
            lo, hi = cuts[k], cuts[k + 1]
            out[b] = HEAD.pack(least[b], min(BLOCK, len(ids) - b * BLOCK), width, hi - lo) + words[k].tobytes() + position[lo:hi].tobytes() + high[lo:hi].tobytes()
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks; ``starts`` are their places in ``data``."""
    heads = [HEAD.unpack_from(data, s) for s in starts.tolist()]
    rows = np.zeros((len(heads), BLOCK), np.uint32)
    for width in {h[2] for h in heads}:
        at = [i for i, h in enumerate(heads) if h[2] == width]
        words = np.frombuffer(b"".join(data[starts[i] + HEAD.size : starts[i] + HEAD.size + width * BLOCK // 8] for i in at), "<u8")
        rows[at] = unpack_bits(words.reshape(len(at), -1), width)
    for i, (least, _, width, patched) in enumerate(heads):
        if patched:
            p = int(starts[i]) + HEAD.size + width * BLOCK // 8
            position = np.frombuffer(data, "<u2", patched, p)
            rows[i, position] |= np.frombuffer(data, "<u4", patched, p + 2 * patched) << np.uint32(width)
        rows[i] += np.uint32(least)
    return np.concatenate([rows[i, : h[1]] for i, h in enumerate(heads)]) if heads else np.zeros(0, np.uint32)


class Writer:
    """Collects documents and writes whole blocks as they fill."""

    def __init__(self, out):
        self.out, self.at = out, out.write(MAGIC) or len(MAGIC)
        self.at = len(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.docs: list[int] = []
        self.counts: list[int] = []
        self.starts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.counts.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= 1 << 20:
            self._write(self.n_waiting // BLOCK * BLOCK)

    def _write(self, n: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        blocks = encode_blocks(ids[:n])
        for b in blocks:
            self.starts.append(self.at)
            self.at += len(b)
        self.out.write(b"".join(blocks))
        self.waiting, self.n_waiting = [ids[n:]], len(ids) - n

    def close(self) -> tuple[int, int]:
        self._write(self.n_waiting)
        index = np.array(self.docs, "<i8").tobytes() + np.array(self.counts, "<i8").tobytes() + np.array(self.starts, "<u8").tobytes()
        self.out.write(index + FOOT.pack(len(self.docs), len(self.starts), self.at, MAGIC))
        return len(self.docs), sum(self.counts)


def read_file(file, blocks_at_once: int = 1024) -> Iterator[tuple[int | None, int, int, np.ndarray]]:
    """(doc_id, ids before it in the file, its number of ids, a part of its ids): parts of a document follow each other."""
    size = file.size()
    file.seek(size - FOOT.size)
    n_docs, n_blocks, at, magic = FOOT.unpack(file.read(FOOT.size))
    if magic != MAGIC:
        raise ValueError("not a token file, or cut short")
    file.seek(at)
    index = file.read(size - FOOT.size - at)
    docs, counts = np.frombuffer(index, "<i8", n_docs), np.frombuffer(index, "<i8", n_docs, 8 * n_docs)
    starts = np.append(np.frombuffer(index, "<u8", n_blocks, 16 * n_docs), at).astype(np.int64)
    before = np.cumsum(counts) - counts
    k, done = 0, 0  # the document to go on with, and how much of it was read
    for b in range(0, n_blocks, blocks_at_once):
        last = min(b + blocks_at_once, n_blocks)
        file.seek(int(starts[b]))
        ids = decode_blocks(file.read(int(starts[last] - starts[b])), starts[b:last] - starts[b])
        p = 0
        while k < n_docs and (p < len(ids) or counts[k] == 0):
            part = ids[p : p + int(counts[k]) - done]
            yield None if docs[k] == NO_ID else int(docs[k]), int(before[k]), int(counts[k]), part
            p, done = p + len(part), done + len(part)
            if done == counts[k]:
                k, done = k + 1, 0


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, text: str = "text", key: str = "doc_id", by_words: bool = False, files: int | None = None, bytes_per_file: int = 64 << 20) -> DataFrame:
    """Write the ids of all texts in ascending order of ``key`` (null first); return the manifest.

    The manifest has part, file, n_docs and n_tokens, one row for each file, in order. A null text is an empty one:
    its document is the end id alone. Rows that agree in key are ordered by a hash of their text and may lie in
    several files. There is a file for about ``bytes_per_file`` of text, unless ``files`` says how many; small tables
    get smaller files, so that all cores write. An empty table gives files without documents. A task that is run
    again writes the same file again and moves it over the first.
    """
    spark = docs.sparkSession
    own = dealt(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if not files:
        total = own.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
        files = max(1, -(-total // bytes_per_file), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (1 << 20))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from weft.llm.encoding import encoder

        store, place = store_of(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        name, encode = f"part-{part:05d}.pfor", encoder(vocabulary, by_words).encode
        store.create_dir(place, recursive=True)
        with store.open_output_stream(f"{place}/_{name}.{attempt}") as out:
            writer = Writer(out)
            for rows, texts in text_slices(batches):
                for doc_id, ids in zip(rows.column("doc_id").to_pylist(), encode(texts), strict=True):
                    writer.add(doc_id, np.append(ids, np.uint32(end_id)))
            n_docs, n_tokens = writer.close()
        store.move(f"{place}/_{name}.{attempt}", f"{place}/{name}")
        yield pa.RecordBatch.from_pylist([{"part": part, "file": name, "n_docs": n_docs, "n_tokens": n_tokens}], MANIFEST)

    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text").asc()]
    rows = own.repartitionByRange(files, *order).sortWithinPartitions(*order, "text")
    return stash(rows.mapInArrow(task_of(run, holds=True), "part int, file string, n_docs long, n_tokens long"))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = store_of(folder)
        for batch in batches:
            for listed in batch.to_pylist():
                out: list[dict] = []
                with store.open_input_file(f"{place}/{listed['file']}") as file:
                    crc = seen = 0
                    for doc_id, before, n, part in read_file(file):
                        crc, seen = zlib.crc32(np.ascontiguousarray(part, "<u4").tobytes(), crc), seen + len(part)
                        if seen == n:
                            out.append({"doc_id": doc_id, "start": listed["start"] + before, "n_tokens": n, "ids_crc32": crc})
                            crc = seen = 0
                        if len(out) >= 10_000:
                            yield pa.RecordBatch.from_pylist(out, READ)
                            out = []
                yield pa.RecordBatch.from_pylist(out, READ)

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over the files, not the documents
    listed = manifest.filter("n_docs > 0").select("part", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    return listed.repartitionByRange(max(1, manifest.count()), "part").mapInArrow(task_of(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_patched_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_dir(spark)
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(manifest, folder)
