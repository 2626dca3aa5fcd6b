"""Secret rules compiled into one pass.

One automaton holds the keywords of all rules; a scan of a text's lower-case copy tells which rules are worth trying, and
only their patterns run. However many rules there are, a table is read once and a text is copied once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType


@dataclass(frozen=True)
class Rule:
    """A pattern for secrets. A text must hold one of ``keywords`` (in any case), if there are any.

    The secret is ``group`` of the pattern (0: the match). It must have ``entropy`` bits a character, match none of the
    ``allow`` patterns and hold none of the ``stop_words``; in files whose path matches ``allow_paths`` the rule finds
    nothing.
    """

    id: str
    pattern: str
    keywords: tuple[str, ...] = ()
    group: int = 0
    entropy: float | None = None
    allow: tuple[str, ...] = ()
    stop_words: tuple[str, ...] = ()
    allow_paths: tuple[str, ...] = ()


def bits_a_character(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


class Rules:
    """Compiled rules; pickled as the rules alone, and compiled once in each task."""

    def __init__(self, rules: list[Rule], mark: str = "[REDACTED]", before: tuple = (), after: tuple = ()):
        """``before`` and ``after``: (pattern, replacement) of shapes that ``redacted`` replaces besides."""
        self.rules, self.mark, self.before, self.after = list(rules), mark, tuple(before), tuple(after)

    def __getstate__(self):
        return {"rules": self.rules, "mark": self.mark, "before": self.before, "after": self.after}

    @cached_property
    def _patterns(self) -> list[tuple]:
        join = lambda patterns: [re.compile(p) for p in patterns]
        return [(re.compile(r.pattern), join(r.allow), [w.lower() for w in r.stop_words], join(r.allow_paths)) for r in self.rules]

    @cached_property
    def _shapes(self) -> tuple[list, list]:
        return [(re.compile(p), by) for p, by in self.before], [(re.compile(p), by) for p, by in self.after]

    @cached_property
    def _always(self) -> set[int]:
        return {i for i, r in enumerate(self.rules) if not r.keywords}

    @cached_property
    def _automaton(self):
        import ahocorasick

        by_word: dict[str, set[int]] = {}
        for i, r in enumerate(self.rules):
            for word in r.keywords:
                by_word.setdefault(word.lower(), set()).add(i)
        automaton = ahocorasick.Automaton()
        for word, owners in by_word.items():
            automaton.add_word(word, owners)
        if by_word:
            automaton.make_automaton()
        return automaton if by_word else None

    def worth_trying(self, text: str) -> list[int]:
        """The rules without keywords and those of whose keywords the text holds one, in the order of the rules."""
        found = set(self._always)
        if self._automaton is not None:
            for _, owners in self._automaton.iter(text.lower()):
                found |= owners
                if len(found) == len(self.rules):
                    break
        return sorted(found)

    def scan(self, text: str, path: str | None = None) -> Iterator[tuple[str, str]]:
        """(rule id, secret), each once, in the order of the rules and of the text."""
        for i in self.worth_trying(text):
            rule, (pattern, allow, stop_words, paths) = self.rules[i], self._patterns[i]
            if path is not None and any(p.search(path) for p in paths):
                continue
            seen = set()
            for m in pattern.finditer(text):
                secret = m[rule.group] or m[0]
                if not secret or secret in seen:
                    continue
                seen.add(secret)
                if rule.entropy is not None and bits_a_character(secret) < rule.entropy:
                    continue
                low = secret.lower()
                if any(p.search(secret) for p in allow) or any(w in low for w in stop_words):
                    continue
                yield rule.id, secret

    def redacted(self, text: str) -> str:
        """``text`` after the shapes that come first, without what the rules find (longest first), after the other shapes."""
        before, after = self._shapes
        for pattern, by in before:
            text = pattern.sub(by, text)
        for secret in sorted({s for _, s in self.scan(text)}, key=lambda s: (len(s), s), reverse=True):
            text = text.replace(secret, self.mark)
        for pattern, by in after:
            text = pattern.sub(by, text)
        return text


def scanned(texts: DataFrame, text: str, rules: Rules, path: str | None = None) -> DataFrame:
    """The rows of ``texts`` without ``text``, once for each (rule_id, secret) in it, by one pass over the table.

    The other columns pass as Arrow data. Null and empty texts hold nothing. ``path`` names the column that the rules'
    path lists look at.
    """
    kept = [f for f in texts.schema.fields if f.name != text]
    schema = StructType([*kept, StructField("rule_id", StringType()), StructField("secret", StringType())])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            ids: list[str] = []
            secrets: list[str] = []
            paths = batch.column(path).to_pylist() if path else None
            for i, value in enumerate(batch.column(text)):
                if value.is_valid:
                    for rule, secret in rules.scan(value.as_py(), paths[i] if paths else None):
                        at.append(i)
                        ids.append(rule)
                        secrets.append(secret)
            rows = [pc.take(batch.column(f.name), pa.array(at, pa.int64())) for f in kept]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(ids, pa.string()), pa.array(secrets, pa.string())], kinds.names)

    return texts.mapInArrow(run, schema)
