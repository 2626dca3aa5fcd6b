"""Recordings that grow: a streaming source that reads files from where it stopped.

    spark.dataSource.register(GrowingLines)
    spark.readStream.format("growing").option("path", folder).option("journal", folder2).load()

A file's place is the byte behind its last whole line. The driver lists files and writes what has changed since the last
version (path, from, to, size) to a journal; the offset of a batch is a version's number, so the query's checkpoint stays
small however many files there are, and a batch that runs again reads the same bytes. Tasks read the bytes: new ones
only, long stretches in pieces.

What stands behind the last newline is given too, with ``whole`` false, and comes again once its line is complete. A file
that got shorter, or changed without growing, is another generation and is read from its start. Files that are gone are
forgotten; one that comes back is read as new.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, generation int, start long, line string, whole boolean"
ARROW = pa.schema([("path", pa.string()), ("generation", pa.int32()), ("start", pa.int64()), ("line", pa.string()), ("whole", pa.bool_())])
#: Bytes looked at on the way back to a newline and read forward at a time, rows of a batch, journals between snapshots.
STEP, ROWS, EVERY = 64 << 10, 10_000, 50


class Stretch(InputPartition):
    """Lines that begin in [start, stop) of files; ``first`` if a line begins at start, ``size`` if the rest is given too."""

    def __init__(self, parts: list[tuple[str, int, int, int, bool, int | None]]):
        self.parts = parts


def last_line_end(file, start: int, size: int) -> int:
    """The place behind the last newline in [start, size), or ``start``."""
    stop = size
    while stop > start:
        at = max(start, stop - STEP)
        file.seek(at)
        found = file.read(stop - at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        stop = at
    return start


def lines_in(file, start: int, stop: int, first: bool, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in [start, stop); the last may go on behind ``stop``, up to ``size``."""
    at = start if first else start - 1
    file.seek(at)
    held, skip = b"", not first
    while at < stop:
        more = file.read(min(1 << 20, size - at - len(held)))
        data = held + more
        *whole, held = data.split(b"\n")
        for line in whole:
            if not skip and at < stop:
                yield at, line
            skip = False
            at += len(line) + 1
            if at >= stop:
                return
        if not more:
            return


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.journal = options["path"], options["journal"]
        self.glob, self.piece = options.get("pathglobfilter", "*"), int(options.get("piecebytes", 64 << 20))
        self.most = int(options.get("maxbytespertrigger", 0))
        self.version, self.known = -1, {}

    def _store(self, folder: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(folder)

    def _versions(self, kind: str) -> list[int]:
        from pyarrow import fs

        store, base = self._store(self.journal)
        listed = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return sorted(int(f.base_name.split(".")[0]) for f in listed if f.base_name.endswith(f".{kind}"))

    def _read(self, version: int, kind: str) -> list[list]:
        store, base = self._store(self.journal)
        with store.open_input_stream(f"{base}/{version:012d}.{kind}") as file:
            return [json.loads(line) for line in file.read().split(b"\n") if line]

    def _write(self, version: int, kind: str, rows: list[list]) -> None:
        store, base = self._store(self.journal)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/_{version}.{kind}") as out:
            for at in range(0, len(rows), 10_000):
                out.write("".join(json.dumps(r) + "\n" for r in rows[at : at + 10_000]).encode())
        store.move(f"{base}/_{version}.{kind}", f"{base}/{version:012d}.{kind}")

    def _load(self) -> None:
        """Places of all files as of the newest version: the last snapshot and the changes since."""
        if self.version >= 0:
            return
        shots = self._versions("all")
        self.version = shots[-1] if shots else 0
        self.known = {r[0]: r[1:] for r in self._read(shots[-1], "all")} if shots else {}
        for v in (v for v in self._versions("new") if v > self.version):
            for r in self._read(v, "new"):
                self._note(r)
            self.version = v

    def _note(self, change: list) -> None:
        path, generation, _, to, size, changed = change
        if size < 0:
            self.known.pop(path, None)
        else:
            self.known[path] = [generation, to, size, changed]

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        self._load()
        store, base = self._store(self.folder)
        listed = [f for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and fnmatch.fnmatch(f.base_name, self.glob)]
        seen, wanted, total = {f.path for f in listed}, [], 0
        for f in sorted(listed, key=lambda f: (f.mtime_ns, f.path)):
            generation, at, size, changed = self.known.get(f.path, [0, 0, 0, 0])
            if f.size == size and (f.mtime_ns == changed or size == 0):
                continue
            if f.size <= size and f.path in self.known:
                generation, at = generation + 1, 0
            wanted.append((f, generation, at))
            total += f.size - at
            if self.most and total >= self.most:
                break

        def change(w) -> list:
            f, generation, at = w
            with store.open_input_file(f.path) as file:
                return [f.path, generation, at, last_line_end(file, at, f.size), f.size, f.mtime_ns]

        with ThreadPoolExecutor(32) as pool:
            changes = list(pool.map(change, wanted)) + [[p, 0, 0, 0, -1, 0] for p in self.known if p not in seen]
        if changes:
            self._write(self.version + 1, "new", changes)
            for c in changes:
                self._note(c)
            self.version += 1
        return {"version": self.version}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        todo: dict[str, list] = {}
        for v in range(start["version"] + 1, end["version"] + 1):
            for path, generation, at, to, size, _ in self._read(v, "new"):
                if size < 0:
                    todo.pop(path, None)
                elif path in todo and todo[path][0] == generation and at:
                    todo[path][2:] = [to, size]
                else:
                    todo[path] = [generation, at, to, size]
        out: list[InputPartition] = []
        parts, held = [], 0
        for path, (generation, at, to, size) in todo.items():
            cuts = [*range(at, to, self.piece), to] if to > at else [at, at]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                parts.append((path, generation, a, b, i == 0, size if b == to else None))
                held += (size if b == to else b) - a
                if held >= self.piece:
                    out.append(Stretch(parts))
                    parts, held = [], 0
        return [*out, *([Stretch(parts)] if parts else [])] or [Stretch([])]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        store, _ = self._store(self.folder)
        rows: list[tuple] = []
        for path, generation, start, stop, first, size in partition.parts:
            with store.open_input_file(path) as file:
                for at, line in lines_in(file, start, stop, first, file.size()):
                    if line.strip():
                        rows.append((path, generation, at, line.decode("utf-8", "replace"), True))
                    if len(rows) >= ROWS:
                        yield self._batch(rows)
                        rows = []
                if size is not None and size > stop:
                    file.seek(stop)
                    rows.append((path, generation, stop, file.read(size - stop).decode("utf-8", "replace"), False))
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 5, ARROW)], schema=ARROW)

    def commit(self, end: dict) -> None:
        """Once in a while all places are written as one snapshot, and the journals before it go."""
        done, journals = end["version"], self._versions("new")
        if done == self.version and len(journals) > EVERY:
            self._write(done, "all", [[p, *r[:1], *r[1:]] for p, r in self.known.items()])
            store, base = self._store(self.journal)
            for v in journals:
                if v <= done:
                    store.delete_file(f"{base}/{v:012d}.new")
            for v in self._versions("all"):
                if v < done:
                    store.delete_file(f"{base}/{v:012d}.all")


class GrowingLines(DataSource):
    """(path, generation, start, line, whole) of the files below ``path``; ``journal`` is a folder of this query alone.

    ``pathGlobFilter`` picks files by name, ``pieceBytes`` sizes tasks, ``maxBytesPerTrigger`` bounds a batch (not under
    ``availableNow``, where a run takes what is there when it begins).
    """

    @classmethod
    def name(cls) -> str:
        return "growing"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)
