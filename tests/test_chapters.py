"""Chains and retry groups by pointers against folds over random sessions."""

import random

from weft.operators import chapters


def fold_chains(links):
    chain, by = {}, {}
    for idx, prev, continues, fixes in links:
        by.setdefault(idx, []).append((prev, continues, fixes))
    for idx in sorted(by):
        wanted = [p for p, c, _ in sorted(by[idx]) if c] + [p for p, _, f in sorted(by[idx]) if f]
        if wanted:
            known = [chain[p] for p in wanted if p in chain]
            chain[idx] = known[0] if known else chain.setdefault(wanted[0], len(set(chain.values())))
    return chain


def test_chains_equal_a_fold(spark):
    rng, rows = random.Random(0), []
    for path in range(60):
        n, density = rng.randint(2, 60), rng.choice([0.03, 0.1, 0.3])
        for idx in range(1, n):
            for prev in range(max(0, idx - 10), idx):
                if rng.random() < density:
                    kind = rng.random()
                    rows.append((f"s{path}", idx, prev, kind < 0.5, kind > 0.4))
    rows += [("long", i, i - 1, True, False) for i in range(1, 400)] + [("steps", i, i - 2 if i % 3 else i - 1, False, True) for i in range(2, 300)] + [("none", 5, 4, False, False)]
    df = spark.createDataFrame(rows, "path string, idx long, prev_idx long, continues boolean, fixes boolean")
    got = chapters.chains(df)
    want = {(p, i): c for p in {r[0] for r in rows} for i, c in fold_chains([r[1:] for r in rows if r[0] == p]).items()}
    assert {(r["path"], r["idx"]): r["chain"] for r in got.collect()} == want and len(want) > 900
    assert "Pandas" not in got._jdf.queryExecution().toString()


def fold_groups(calls, ahead=8):
    out, i = [], 0
    while i < len(calls):
        group = [i]
        if calls[i][1]:
            for j in range(i + 1, min(i + ahead, len(calls))):
                if calls[j][0] == calls[i][0]:
                    group.append(j)
                    if not calls[j][1]:
                        break
        if len(group) > 1:
            out.append((i, len(group), not calls[group[-1]][1]))
        i = group[-1] + 1 if len(group) > 1 else i + 1
    return out


def test_retry_groups_equal_a_fold(spark):
    rng, rows, want = random.Random(1), [], set()
    for chapter in range(120):
        n, failing = rng.choice([1, 5, 30, 200]), rng.choice([0.1, 0.5, 0.95, 1.0])
        calls = [(rng.choice("abc"), rng.random() < failing) for _ in range(n)]
        rows += [("p", chapter, i, "Bash", t, f) for i, (t, f) in enumerate(calls)]
        want |= {("p", chapter, *g) for g in fold_groups(calls)}
    df = spark.createDataFrame(rows, "path string, chapter long, ord long, tool string, target string, failed boolean")
    got = chapters.retry_groups(df)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 200
    assert "Pandas" not in got._jdf.queryExecution().toString()
