"""Text out of JSON whose shape isn't known: strings by key, by length and by what they look like."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys whose values may be text, the least length of a text, how deep it may lie, how many are taken of a line.
TEXT_KEYS = ("content", "text", "thinking", "output", "result", "error", "stderr", "stdout", "message", "prompt", "description", "query", "command", "response", "lastPrompt")
LEAST, DEEPEST, MOST = 30, 8, 100
# Strings that are no text: a path, an address, a digest, base 64, JSON.
NO_TEXT = (r"^\s*/[-._a-zA-Z0-9/]+\s*$", r"^https?://", r"(?i)^[0-9a-f]{32,}$", r"^[A-Za-z0-9+/]{40,}={0,2}$", r"(?s)^\{.*\}$", r"(?s)^\[.*\]$")
# Blocks of a message that carry text.
TEXT_BLOCKS = ("text", "input_text", "output_text")

_NO_TEXT = [re.compile(p) for p in NO_TEXT]


def is_text(s: str) -> bool:
    """Whether a string reads as text: not a path, address, digest, code or JSON, nor mostly signs."""
    signs = sum(not (c.isascii() and (c.isalnum() or c == "_") or c.isspace()) for c in s)
    return not any(p.search(s) for p in _NO_TEXT) and signs / len(s) <= 0.7


def strings(value, deepest: int | None = DEEPEST) -> Iterator[str]:
    """All strings inside lists and objects, in order, at most ``deepest`` levels down."""
    stack = [(value, 0)]
    while stack:
        v, depth = stack.pop()
        if isinstance(v, str):
            yield v
        elif isinstance(v, list | dict) and (deepest is None or depth <= deepest):
            stack += [(x, depth + 1) for x in reversed(v if isinstance(v, list) else list(v.values()))]


def extracted(value, keys: frozenset[str] = frozenset(TEXT_KEYS), least: int = LEAST, deepest: int = DEEPEST, most: int = MOST) -> list[str]:
    """The different texts below the whitelisted keys of a JSON value, with spaces collapsed, in order, ``most`` of them.

    A value that is itself a string or a list counts as if it stood below such a key.
    """
    found: dict[str, None] = {}
    stack = [(value, 0)]
    while stack and len(found) < most:
        v, depth = stack.pop()
        if depth > deepest:
            continue
        if isinstance(v, str):
            s = v.strip()
            if len(s) >= least and is_text(s):
                found[re.sub(r"\s+", " ", s)] = None
        elif isinstance(v, list):
            stack += [(x, depth + 1) for x in reversed(v)]
        elif isinstance(v, dict):
            stack += [(x, depth + 1) for k, x in reversed(v.items()) if k in keys]
    return list(found)


def _parsed(line: str | None):
    try:
        return json.loads(line) if line else None
    except (ValueError, RecursionError):
        return None


def texts_of(line: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The texts inside a JSON line, as ``extracted``; none for null and for what isn't JSON. Lines without any of the
    keys never reach Python."""

    @F.pandas_udf("array<string>")
    def walk(lines: pd.Series) -> pd.Series:
        return lines.map(lambda s: extracted(_parsed(s), least=least, most=most))

    may = line.rlike('"(?:' + "|".join(TEXT_KEYS) + ')"')
    return F.when(F.coalesce(may, F.lit(False)), walk(line)).otherwise(F.array().cast("array<string>"))


def strings_of(json_text: Column, deepest: int = DEEPEST) -> Column:
    """All strings inside a JSON text, decoded; a text that isn't JSON is one string; null gives none."""

    @F.pandas_udf("array<string>")
    def walk(texts: pd.Series) -> pd.Series:
        def one(s):
            if s is None:
                return []
            value = _parsed(s)
            return [s] if value is None or isinstance(value, int | float) else list(strings(value, deepest))

        return texts.map(one)

    return walk(json_text)


def blocks_text(content: Column) -> Column:
    """The text of message content: a string as it is, of a list or object the text of its text blocks, one a line."""
    kind = "struct<type:string,text:string>"
    start = F.substring(F.ltrim(content), 1, 1)
    many = F.when(start == "[", F.from_json(content, f"array<{kind}>")).when(start == "{", F.array(F.from_json(content, kind)))
    said = F.transform(F.filter(many, lambda b: b["type"].isin(*TEXT_BLOCKS) & (F.coalesce(b["text"], F.lit("")) != "")), lambda b: b["text"])
    return F.when(many.isNotNull(), F.array_join(said, "\n")).otherwise(F.coalesce(content, F.lit("")))


def fallback_chunks(lines: DataFrame, key: str = "path", order: str = "seq", line: str = "line", most: int = MOST) -> DataFrame:
    """(key, text) of the first ``most`` different texts of each file of an unknown format, by the line they first stand in.

    Equal texts of a file are one before anything is ranked, so a file's repeats don't gather in a task.
    """
    from pyspark.sql import Window

    each = lines.select(key, order, F.posexplode(texts_of(F.col(line))).alias("at", "text"))
    first = each.groupBy(key, "text").agg(F.min(F.struct(order, "at")).alias("first"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("first")))
    return ranked.filter(F.col("rank") <= most).select(key, "rank", "text")
