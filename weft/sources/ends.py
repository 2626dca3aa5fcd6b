"""The beginnings and ends of files, read by place: a preview or a live state costs the same however long a file is."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Bytes of a preview, bytes of a tail, and the longest last line that a tail still takes whole.
HEAD, TAIL, LONGEST = 512 << 10, 128 << 10, 2 << 20
ROWS = pa.schema([("path", pa.string()), ("seq", pa.int64()), ("line", pa.string()), ("mid_write", pa.bool_())])


def _open(path: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return store.open_input_file(at)


def head_of(file, most: int) -> list[tuple[int, bytes]]:
    """(place, line) of the whole lines within the first ``most`` bytes; a file's last line needs no end."""
    size = file.size()
    data = file.read(min(most, size))
    lines = data.split(b"\n")
    if len(data) < size:
        lines.pop()
    out, at = [], 0
    for line in lines:
        if line.strip():
            out.append((at, line))
        at += len(line) + 1
    return out


def tail_of(file, most: int, longest: int) -> list[tuple[int, bytes]]:
    """(place, line) of the lines that begin in the last ``most`` bytes; the line that reaches into them from before comes
    too, if it begins in the last ``longest`` bytes, so a long last line is there."""
    size = file.size()
    start, whole = max(0, size - most), size <= most
    stop = start
    while not whole and stop > max(0, size - longest):
        begin = max(0, size - longest, stop - (64 << 10))
        file.seek(begin)
        found = file.read(stop - begin).rfind(b"\n")
        if found >= 0 or begin == 0:
            start, whole = begin + found + 1, True
        stop = begin
    file.seek(start)
    data = file.read(size - start)
    out, at = [], start
    for i, line in enumerate(data.split(b"\n")):
        if line.strip() and (i or whole):
            out.append((at, line))
        at += len(line) + 1
    return out


def _unfinished(line: bytes) -> bool:
    try:
        json.loads(line)
    except ValueError:
        return True
    return False


def _read(paths: DataFrame, lines) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with _open(path) as file:
                    found = lines(file)
                broken = bool(found) and _unfinished(found[-1][1])
                columns = [[path] * len(found), [at for at, _ in found], [line.decode("utf-8", "replace") for _, line in found], [broken] * len(found)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ROWS, strict=True)], schema=ROWS)

    return paths.select("path").mapInArrow(run, "path string, seq long, line string, mid_write boolean")


def heads(paths: DataFrame, most: int = HEAD) -> DataFrame:
    """(path, seq, line) of the whole lines in the first ``most`` bytes of each file; ``seq`` is a line's place."""
    return _read(paths, lambda file: head_of(file, most)).drop("mid_write")


def tails(paths: DataFrame, most: int = TAIL, longest: int = LONGEST) -> DataFrame:
    """(path, seq, line, mid_write) of the last lines of each file; ``mid_write``: the last one isn't whole JSON yet."""
    return _read(paths, lambda file: tail_of(file, most, max(most, longest)))
