"""Source divergence against plain dictionaries of whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import divergence

DOCS = "doc_id long, text string, lang string, source string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, best=10):
    counts, df, groups, terms = defaultdict(Counter), defaultdict(Counter), defaultdict(set), {}
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(words)
        df[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in df[lang].items() if n >= least)

        def rate(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        p, q = {s: rate(counts[lang, s]) for s in sources}, rate(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, best)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])}
    return out


def same(spark, rows, **options):
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("n", "term", "kind", "pair", "block")}).repartition(3)
    got = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.source_divergence(docs, **options).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def random_rows(n, seed, sources=9):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abÄßé中\U0001f600Z") for _ in range(rng.randint(1, 3))) for _ in range(150)]
    return [(i, rng.choice([None, "", "1 2 3"]) if rng.random() < 0.1 else rng.choice([" ", "\x00", "_", "7"]).join(rng.choices(words, k=rng.choice([1, 20, 200]))), rng.choice(["en", "en", "de", None, ""]), rng.choice([f"s{rng.randrange(sources)}", "hot", None])) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"terms_per_block": 16, "sources_per_block": 2}, {"terms_per_block": 7, "sources_per_block": 100}])
def test_equals_plain_loops(spark, options):
    same(spark, random_rows(500, 1), **options)


def test_few_and_equal_rows(spark):
    same(spark, [(1, "a b", "en", "x"), (2, None, "en", "y"), (None, "a", "fr", None)])  # nothing kept: pairs are 0
    same(spark, [(1, "Same words HERE", "en", s) for s in "xyz" for _ in range(12)] + [(2, "z" * 100_000 + " " + "w " * 300_000, "en", "x")] * 11)
    assert divergence.source_divergence(spark.createDataFrame([], DOCS)).collect() == []


def test_counts_flush_and_long_texts(spark, monkeypatch):
    assert [w for ws in divergence.word_lists(b"Ab c\x00d 9 " * 10, 7) for w in ws] == [b"ab", b"c", b"d"] * 10
    assert list(divergence.word_lists(b"x" * 100, 7)) == [[b"x" * 100]]
    monkeypatch.setattr(divergence, "HELD", 5)
    same(spark, random_rows(60, 2))


def test_rates_are_exact():
    rng = random.Random(3)
    for total in (1, 999, 10**9 + 7, 4 * 10**15):
        n = [rng.randint(0, total) for _ in range(50)] + [0, total]
        assert divergence.rates(np.array(n), total, 12).tolist() == [1 + 10**9 * (x + 2) // (total + 24) for x in n]
