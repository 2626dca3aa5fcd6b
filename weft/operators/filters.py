"""Predicates over session rows, to be combined with & | ~.

All are two-valued: a missing value makes a predicate false, so its negation is true.
"""

from __future__ import annotations

import operator
import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import duration_literal_ms, session_hash

_OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def project(text: str) -> Column:
    return _sure(F.lower("project").contains(text.lower()))


def model(text: str) -> Column:
    return _sure(F.lower("model").contains(text.lower()))


def source(name: str) -> Column:
    return _sure(F.lower("source") == name.lower())


def host(name: str) -> Column:
    own = F.lower(F.coalesce("host", F.lit("")))
    return (own == name.lower()) | ((own == "") & F.lit(name.lower() == "local"))


def tool(name: str) -> Column:
    return _sure(F.exists("tools", lambda t: F.lower(t) == name.lower()))


def grade(letter: str) -> Column:
    return _sure(F.col("grade_letter") == letter.upper())


def errors(op: str, n: int) -> Column:
    return _OPS[op](F.coalesce("errors", F.lit(0)), n)


def size_kb(op: str, n: int) -> Column:
    return _OPS[op](F.floor(F.coalesce("size", F.lit(0)) / 1024), n)


def age(op: str, literal: str, now_ms: int) -> Column:
    """Against a literal such as ``12h``; ``now_ms`` is given, so a query's result doesn't depend on the clock."""
    return _sure(_OPS[op](F.lit(now_ms) - F.col("mtime_ms"), duration_literal_ms(literal)))


def live() -> Column:
    return _sure(F.col("live"))


def text(words: str) -> Column:
    """In prompt, project, id or model."""
    fields = F.concat_ws("\n", "first_prompt", "project", "session_hash", "model")
    return _sure(F.lower(fields).contains(words.lower()))


def between(since_ms: int, before_ms: int) -> Column:
    return _sure((F.col("mtime_ms") >= since_ms) & (F.col("mtime_ms") < before_ms))


def free_text(words: str, index_match: Column | None = None) -> Column:
    """A row that ``words`` name by id, that an index found, or (without one) that has them in its text."""
    named = id_matches(words)
    return named | F.coalesce(index_match, F.lit(False)) if index_match is not None else named | text(words)


def id_matches(words: str) -> Column:
    """The 8 hex digits of a session's hash, or a UUID in its path."""
    w = words.strip().lower()
    if re.fullmatch("[0-9a-f]{8}", w):
        return session_hash(F.col("path")) == w
    return F.lower("path").contains(w) if re.fullmatch("[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", w) else F.lit(False)


def named_first(rows: DataFrame, words: str, *order: Column) -> DataFrame:
    """``rows`` in ``order``, but those that ``words`` name by id lead."""
    return rows.orderBy(id_matches(words).desc(), *order)


def standup_window(kind: str, now: datetime) -> tuple[datetime, datetime | None]:
    """[since, before) of today, yesterday, workday, previous-workday or a duration like 2h, in the time of ``now``."""
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if kind == "today":
        return day, None
    if kind == "yesterday":
        return day - timedelta(days=1), day
    if kind in ("workday", "previous-workday"):
        if kind == "previous-workday":
            day -= timedelta(days={0: 3, 6: 2}.get(day.weekday(), 1))
        return day + timedelta(hours=9), day + timedelta(hours=17)
    return now - timedelta(milliseconds=duration_literal_ms(kind)), None


def in_window(time: Column, window: tuple[datetime, datetime | None]) -> Column:
    since, before = window
    return (time >= F.lit(since)) & ((time < F.lit(before)) if before else F.lit(True))


def chapter_matches(words: str | None = None, tools: list[str] | None = None, wasteful: bool | None = None, fields: tuple[str, ...] = ("prompt", "answer")) -> Column:
    """Chapters (tools, wasteful and text ``fields``) that hold ``words`` in any case, use one of ``tools``, are wasteful."""
    wanted = F.lit(True)
    if words:
        wanted = wanted & F.lower(F.concat_ws("\n", *fields)).contains(words.lower())
    if tools:
        wanted = wanted & F.arrays_overlap("tools", F.array(*map(F.lit, tools)))
    return wanted & (F.col("wasteful") == wasteful) if wasteful is not None else wanted
