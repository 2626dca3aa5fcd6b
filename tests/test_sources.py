"""Bounded reads, deep folders, several databases, segments with stored columns, compare with what was written."""

import json
import sqlite3

import zstandard
from pyspark.sql import functions as F

from weft.operators import chapter_table, timing
from weft.sources import discovery, recordings


def test_first_lines_read_no_further(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("one\ntwo\n" + "x" * 100_000)
    (tmp_path / "b.jsonl").write_text("")
    (tmp_path / "c.jsonl").write_text("y" * 300_000 + "\nz")
    (tmp_path / "d.zstd").write_bytes(zstandard.compress(b'{"a":') + zstandard.compress(b"1}\nrest") + b"damaged")
    df = spark.createDataFrame([(str(tmp_path / n), 1) for n in ("a.jsonl", "b.jsonl", "c.jsonl", "d.zstd")] + [(f"file:{tmp_path}/a.jsonl", 2)], "path string, n int")
    got = [(r["path"][-7:], r["n"], r["line"]) for r in recordings.first_lines(df, most=200_000).collect()]
    assert got == [("a.jsonl", 1, "one"), ("b.jsonl", 1, ""), ("c.jsonl", 1, "y" * 200_000), ("/d.zstd", 1, '{"a":1}'), ("a.jsonl", 2, "one")]


def test_codex_projects_at_any_depth(spark, tmp_path):
    for depth in range(1, 11):
        folder = tmp_path.joinpath(*"abcdefghij"[:depth])
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"rollout-{depth}.jsonl").write_text(json.dumps({"payload": {"cwd": f"/code/proj{depth}/"}}) + "\n{}\n")
    (tmp_path / "a" / "rollout-none.jsonl").write_text("no json")
    found = {r["file"]: r["project"] for r in discovery.codex(spark, f"file://{tmp_path}").collect()}
    assert found == {f"rollout-{i}.jsonl": f"proj{i}" for i in range(1, 9)} | {"rollout-none.jsonl": "codex"}


def test_databases_by_pattern(spark, tmp_path):
    for name, rows in (("a", [(1, "x"), (2, None)]), ("b", [(3, "z")]), ("c", [])):
        with sqlite3.connect(tmp_path / f"{name}.db") as db:
            db.execute("create table t (id integer, v text)")
            db.executemany("insert into t values (?, ?)", rows)
    spark.dataSource.register(recordings.SqliteSource)
    read = lambda path: sorted(map(tuple, spark.read.format("sqlite").schema("id long, v string").option("path", path).option("dbtable", "t").option("numpartitions", "2").load().collect()))
    assert read(f"{tmp_path}/*.db") == [(1, "x"), (2, None), (3, "z")] and read(f"file://{tmp_path}/b.db") == [(3, "z")]


def test_time_lines(spark):
    rows = [("a", i, t) for i, t in enumerate([0, 5_000, 125_000, 400_000, 400_500, None])] + [("few", 1, 0), ("few", 2, 500_000)] + [("short", i, i * 1000) for i in range(5)]
    got = timing.activity_segments(spark.createDataFrame(rows, "path string, seq long, ms long"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 0, 5_000, True), ("a", 5_000, 125_000, False), ("a", 125_000, 400_000, False), ("a", 400_000, 400_500, True)]


EVENT = "path string, seq long, type string, ts timestamp, text string, tool_calls array<struct<id:string,name:string,input:string>>, tool_use_id string, is_error boolean, usage struct<input:long,output:long,cache_read:long,cache_write:long>"


def events(spark, rows):
    return spark.createDataFrame([("p", i, r[0], None, r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, r[4] if len(r) > 4 else None, r[5] if len(r) > 5 else None) for i, r in enumerate(rows)], EVENT)


def test_chapter_rows(spark):
    read = [("i", "Read", '{"file_path":"/a/b/c.py"}'), (None, "Grep", '{"pattern":"q\\u0041z"}')]
    rows = [("tool_result", "before all"), ("assistant", "short"), ("assistant", "a reply of more than twenty characters"), ("user", ""), ("user", "go"), ("assistant", "x", read, None, None, (1, 2, 3, 4)), ("tool_result", "bad", None, "i", True), ("tool_result", "", None, None, True), ("tool_result", "odd", None, "unknown", True), ("assistant", "", [("j", "Edit", '{"file_path":"/a/b/c.py"}')], None, None, (10, 20, None, None)), ("user", "next")]
    found = chapter_table.chapter_table(events(spark, rows)).orderBy("chapter").collect()
    assert [(r["chapter"], r["prompt"], r["turns"], r["errors"]) for r in found] == [(0, rows[2][1], 2, 0), (1, "go", 2, 3), (2, "next", 0, 0)]
    one = found[1]
    assert (one["tokens_in"], one["tokens_out"], one["cache_read"], one["last_text"]) == (11, 22, 3, "x")
    assert one["tool_counts"] == {"Read": 1, "Grep": 1, "Edit": 1} and one["files"] == {"b/c.py": ["Read", "Edit"]} and one["error_tools"] == {"Read": 1} and one["standalone"] == ["(unknown error)"]
    holding = lambda words: {r["chapter"] for r in chapter_table.chapters_holding(events(spark, rows), words).collect()}
    assert holding("QAZ") == {1} and holding("grep") == {1} and holding("BEFORE") == set() and holding("twenty") == {0} and holding("c.py") == {1} and holding("nowhere") == set()
    assert chapter_table.chapter_table(events(spark, [("tool_result", "x"), ("user", None)])).collect() == []


def test_unified_diffs(spark):
    text = "--- a/x.py\n+++ b/x.py\n@@ -1 +1,2 @@\n-a\n+b\n+c\n--- a/gone\n+++ /dev/null\n-z\n"
    df = spark.createDataFrame([(1, text), (2, "--- only a rule\nno diff"), (3, None), (4, "")], "i long, t string")
    got = {r["i"]: r["d"] for r in df.select("i", chapter_table.diff_summary(F.col("t")).alias("d")).collect()}
    assert (got[1]["files"], got[1]["added"], got[1]["removed"]) == (["x.py", "gone"], 2, 2) and got[2] is got[3] is got[4] is None
