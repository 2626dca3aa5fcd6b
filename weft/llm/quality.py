"""Quality rules over repetition: how much of a text lies inside n-grams and lines that it repeats.

Words become random 64-bit values, and the hash of an n-gram rolls into that of the next length with one
multiplication for all positions at once, so several lengths cost little more than one. Positions whose hash occurs
again are marked, and the characters of the words that they cover are measured.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import rows_whose, table, with_columns_of

SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\v\f\r"
#: n-gram length: most of a text's word characters that repeated n-grams of this length may cover.
COVERAGE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Most of a text's characters that lines equal to an earlier line may hold.
LINE_COVERAGE = 0.30
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _random(ids: np.ndarray) -> np.ndarray:
    z = (ids + np.uint64(1)) * _MULTIPLIER
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def repeated_words(ids: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(n, words inside n-grams that occur twice or more, the first included) for ascending lengths."""
    value = _random(ids.astype(np.uint64))
    h, n = value, 1
    for length in lengths:
        covered = np.zeros(len(ids) + 1, np.int64)
        while n < length and len(h):
            h = h[:-1] * _MULTIPLIER + value[n:]
            n += 1
        if len(h) > 1:
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            again = np.zeros(len(h), bool)
            again[order[1:][same]] = again[order[:-1][same]] = True
            at = np.flatnonzero(again)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + length, -1)
        inside = np.cumsum(covered[:-1]) > 0
        yield length, inside
        if not inside.any():  # then longer n-grams don't repeat either
            return


def measure(text: str | None) -> tuple[list[int], float, float]:
    """(FIELDS, excess of n-gram coverage, line coverage); excess over 1 breaks the rule of some length."""
    text = text or ""
    words = text.encode().split()
    n_chars = len(text) - sum(map(text.count, BLANKS))
    n_dup_lines = dup_chars = 0
    if "\n" in text:
        seen: set[str] = set()
        for line in text.split("\n"):
            if line.strip(BLANKS):
                if line in seen:
                    n_dup_lines += 1
                    dup_chars += len(line)
                seen.add(line)
    n_repeat, excess = 0, 0.0
    if len(words) >= min(COVERAGE):
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
        size = None
        for n, inside in repeated_words(ids, sorted(COVERAGE)):
            if n == 5:
                n_repeat = int(inside.sum())
            if inside.any():
                size = np.array([len(w.decode()) for w in number], np.int64)[ids.astype(np.int64)] if size is None else size
                excess = max(excess, float(size[inside].sum()) / n_chars / COVERAGE[n])
    return [len(words), n_chars, sum(map(text.count, SYMBOLS)), n_dup_lines, n_repeat], excess, dup_chars / max(1, len(text))


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: its key as doc_id, FIELDS, base_failed, ngram_excess, line_coverage, kept.

    A null text has no words, so it fails like any text of fewer than 10 words. Repeated rows and null ids are judged
    like others; an empty table gives an empty result.
    """

    def compute(texts: list[str | None]) -> list:
        got = [measure(t) for t in texts]
        return [*([m[0][i] for m in got] for i in range(len(FIELDS))), [m[1] for m in got], [m[2] for m in got]]

    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    measured = with_columns_of(own, ", ".join(f"{f} long" for f in FIELDS) + ", ngram_excess double, line_coverage double", compute)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("ngram_excess") <= 1) & (F.col("line_coverage") <= LINE_COVERAGE))


def is_good(text: str | None) -> bool:
    (n_words, *_, n_repeat), excess, lines = measure(text)
    return n_words >= 10 and 100 * n_repeat <= 20 * n_words and excess <= 1 and lines <= LINE_COVERAGE


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is kept, with their columns unchanged; texts are judged in place."""
    return rows_whose(docs, lambda texts: [is_good(t) for t in texts], text)


def op6_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *FIELDS, "base_failed", "kept", "ngram_excess", "line_coverage")
