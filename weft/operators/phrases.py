"""Phrases in recordings, as they were written: in a line, in the strings that its JSON encodes, in file paths.

Beside each file lies a Bloom filter of the trigrams of its lines and of their decoded strings, lower-cased. A search
reads the filters, and then only the files that may hold the phrase. Filters lose nothing: a file that is skipped has no
such phrase.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.ragged import _parsed, strings, strings_of

#: Bits of a filter (a power of two), and trigrams that are set or looked at at a time.
BITS, HELD = 1 << 17, 1 << 16


def trigram_bits(text: str, bits: int = BITS) -> set[int]:
    """The bit of each trigram of a lower-case text."""
    data = text.encode("utf-32-le")
    return {zlib.crc32(data[i : i + 12]) & (bits - 1) for i in range(0, len(data) - 8, 4)}


def shown(line: str) -> Iterator[str]:
    """A line and, where JSON escapes hide something, the strings inside it."""
    yield line
    if "\\" in line:
        value = _parsed(line)
        if value is not None:
            yield from strings(value, None)


def filters(lines: DataFrame, key: str = "path", line: str = "line", bits: int = BITS) -> DataFrame:
    """(key, bloom): a filter for each file of ``lines`` (key, line). Tasks set bits for the files they meet, and only
    filters are exchanged; those of a file are joined bit by bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([np.packbits(b).tobytes() for b in own.values()], pa.binary())], ["key", "bloom"])

        for batch in batches:
            for k, text in zip(batch.column("key").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if k not in own and len(own) >= 256:
                    yield flush()
                    own.clear()
                flags = own.setdefault(k, np.zeros(bits, np.uint8))
                for part in shown(text or ""):
                    low = part.lower()
                    for at in range(0, len(low), HELD):
                        flags[list(trigram_bits(low[at : at + HELD + 2], bits))] = 1
        yield flush()

    def joined(pieces: pd.DataFrame) -> pd.DataFrame:
        whole = np.zeros(bits // 8, np.uint8)
        for b in pieces["bloom"]:
            whole |= np.frombuffer(b, np.uint8)
        return pd.DataFrame({"key": [pieces["key"].iloc[0]], "bloom": [whole.tobytes()]})

    rows = lines.select(F.col(key).cast("string").alias("key"), F.col(line).alias("line"))
    return rows.mapInArrow(run, "key string, bloom binary").groupBy("key").applyInPandas(joined, "key string, bloom binary").withColumnRenamed("key", key)


def candidates(stored: DataFrame, phrase: str, key: str = "path", bits: int = BITS) -> DataFrame:
    """(key) of the files whose filter has every trigram of ``phrase``; of a phrase of two characters or fewer, all."""
    wanted = sorted(trigram_bits(phrase.lower(), bits))
    if not wanted:
        return stored.select(key)

    @F.pandas_udf("boolean")
    def may(blooms: pd.Series) -> pd.Series:
        at, mask = np.array(wanted) // 8, 128 >> (np.array(wanted) % 8)
        return blooms.map(lambda b: bool((np.frombuffer(b, np.uint8)[at] & mask == mask).all()))

    return stored.filter(may("bloom")).select(key)


def matches(lines: DataFrame, phrase: str, key: str = "path", line: str = "line") -> DataFrame:
    """The rows of ``lines`` that hold ``phrase`` in any case: in the line as it stands or in a string inside it.

    Strings are decoded only for lines that don't show the phrase and have escapes.
    """
    low, text = phrase.lower(), F.coalesce(F.col(line), F.lit(""))
    plain = F.lower(text).contains(low)
    hidden = F.when(~plain & text.contains("\\"), F.exists(strings_of(F.when(~plain & text.contains("\\"), text), 2**31 - 1), lambda s: F.lower(s).contains(low)))
    return lines.filter(plain | F.coalesce(hidden, F.lit(False)))


def sessions_with(files: DataFrame, stored: DataFrame, phrase: str, key: str = "path", line: str = "line") -> DataFrame:
    """(key) of the files that hold ``phrase``. ``files`` are lines of all files (key, line), partitioned or listed by
    key: a list of the candidates filters the scan. With more than 10,000 candidates they are joined."""
    named = candidates(stored, phrase, key)
    few = [r[0] for r in named.limit(10_001).collect()]
    rows = files.filter(F.col(key).cast("string").isin(few)) if len(few) <= 10_000 else files.join(named, files[key].cast("string") == named[key], "left_semi")
    return matches(rows, phrase, key, line).select(key).distinct()
