"""Segments: what a batch costs, rows that share a key, and merges that leave parts as they stand."""

import pytest
from pyspark.sql import functions as F

from weft.operators import search, segments
from weft.operators.segments import Segments

SCHEMA = "doc_id long, text string, mtime long, gone boolean"
ODD = ["XMLParser readsFile42 a-b  aB AB1 Ünï", "ABcDEf9G hTTPServer2X", "aſBKİ Éa1é x", "", None, "x" * 33, "y" * 32 + " z", "a\u0000b cD", "word " * 50]


def held(index):
    post, lengths = index.current()
    return sorted(map(tuple, post.collect())), sorted(map(tuple, lengths.collect()))


def wanted(spark, texts):
    counts = search.counted(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    return sorted(map(tuple, counts.filter("term is not null").collect())), sorted(map(tuple, counts.groupBy("doc_id").agg(F.sum("tf")).collect()))


def test_rows_are_counted_where_they_are_read(spark):
    rows = [(i % 20, (ODD[i % len(ODD)] or "") * (i % 3 + 1) if i % 7 else None, i) for i in range(90)]
    df = spark.createDataFrame(rows, "k long, text string, n long").repartition(3)
    got = search.counted_rows(df, "k", "text", "n", most=20)
    assert "Exchange" not in search.counted_rows(spark.range(5).select("id", F.lit("a").alias("text")), "id", "text")._jdf.queryExecution().executedPlan().toString()
    got = got.persist()
    heads = {r["row"]: r for r in got.filter("term is null").collect()}
    assert sorted((r["k"], r["n"]) for r in heads.values()) == sorted((k, n) for k, _, n in rows)
    assert got.filter("term is not null and n is not null").count() == 0
    want = search.counted(df.withColumn("k", F.col("n")), "k").filter("term is not null").collect()
    terms = got.filter("term is not null").collect()
    assert sorted((heads[r["row"]]["n"], r["term"], r["tf"]) for r in terms) == sorted(map(tuple, want))
    assert all(r["k"] == heads[r["row"]]["k"] for r in terms)
    assert all(h["tf"] == sum(r["tf"] for r in terms if r["row"] == h["row"]) for h in heads.values())
    got.unpersist()


def test_newest_row_of_a_key_counts_and_rows_without_key_do_not(spark, tmp_path):
    index = Segments(spark, f"file://{tmp_path}")
    rows = [(1, "old words", 1, None), (1, "new words", 2, False), (2, "kept", 5, None), (2, "late", 4, True), (3, "same same", 1, None), (3, "same same", 1, None), (4, "was", 1, None), (4, "is gone", 2, True), (None, "no key", 1, None), (5, None, 1, None)]
    index.add(spark.createDataFrame(rows, SCHEMA), 0)
    assert held(index) == wanted(spark, {1: "new words", 2: "kept", 3: "same same", 5: ""})


@pytest.mark.parametrize("most", [segments.MOST_KEYS, 0])
def test_levels_that_fill_are_merged_in_one_go(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(segments, "MOST_KEYS", most)
    merged, merge = [], Segments._merge
    monkeypatch.setattr(Segments, "_merge", lambda self, parts, *rest: (merged.append((rest[0], len(parts))), merge(self, parts, *rest))[1])
    index, state = Segments(spark, f"file://{tmp_path}", fan=2), {}
    for number in range(4):
        # most of a segment is left, or little of it, or nothing, or all
        rows = [(d, f"text {number} of {d}", number, number == 3 and d < 3 or None) for d in range(10) if number != 1 or d > 6 or d == 2]
        rows = rows if number != 3 else rows[:4]
        state |= {d: None if gone else text for d, text, _, gone in rows}
        index.add(spark.createDataFrame(rows, SCHEMA), number)
        assert held(index) == wanted(spark, {d: t for d, t in state.items() if t is not None})
    assert merged == [("m000000000001-1", 2), ("m000000000003-2", 3)] and len(index.manifest()) == 1


def test_segments_that_delete_each_others_documents(spark, tmp_path):
    index = Segments(spark, f"file://{tmp_path}", fan=2)
    index.add(spark.createDataFrame([(1, None, 9, True), (2, "old two", 1, None)], SCHEMA), 0)
    index.add(spark.createDataFrame([(1, "old one", 1, None), (2, None, 9, True)], SCHEMA), 1)
    assert held(index) == ([], [])
    index.add(spark.createDataFrame([(3, "three", 1, None)], SCHEMA), 2)
    assert held(index) == wanted(spark, {3: "three"})


def test_merged_postings_are_sorted_in_each_file(spark, tmp_path):
    index = Segments(spark, f"file://{tmp_path}", fan=2)
    index.add(spark.createDataFrame([(d, f"w{d * 7 % 50} w{d % 13} all", 1, None) for d in range(200)], SCHEMA), 0)
    index.add(spark.createDataFrame([(d, None, 2, True) for d in range(0, 200, 5)], SCHEMA), 1)
    name = index.manifest()[0][0]
    rows = spark.read.parquet(f"file://{tmp_path}/{name}/postings").select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"), "term", "doc_id").orderBy("i").collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(r["f"], []).append((r["term"], r["doc_id"]))
    assert len(rows) and all(v == sorted(v) for v in by_file.values())
