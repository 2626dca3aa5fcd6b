"""The growing source against whole files, states that shrink, record kinds of each source."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from weft.operators import timing
from weft.sources.growing import GrowingLines, GrowingReader, lines_in
from weft.streaming import spans


class Files:
    """A folder that is written to, and a reader of it that may be started again."""

    def __init__(self, folder, **options):
        self.folder, self.options = folder / "in", {"path": str(folder / "in"), "journal": str(folder / "journal"), **options}
        self.folder.mkdir()
        self.restart(0)

    def restart(self, version=None):
        self.reader, self.at = GrowingReader(self.options), {"version": self.at["version"] if version is None else version}

    def write(self, name, data):
        before = os.stat(self.folder / name).st_mtime_ns if (self.folder / name).exists() else 0
        (self.folder / name).write_bytes(data)
        os.utime(self.folder / name, ns=(before + 1000, before + 1000))

    def batch(self):
        end = self.reader.latestOffset()
        rows = [r for p in self.reader.partitions(self.at, end) for b in self.reader.read(p) for r in b.to_pylist()]
        self.reader.commit(end)
        self.at = end
        return [(os.path.basename(r["path"]), r["generation"], r["start"], r["line"], r["whole"]) for r in rows]


def test_appends_give_new_bytes_only(tmp_path):
    f = Files(tmp_path)
    assert f.batch() == []
    f.write("a", b"one\ntwo\nthr")
    assert f.batch() == [("a", 0, 0, "one", True), ("a", 0, 4, "two", True), ("a", 0, 8, "thr", False)]
    assert f.batch() == []
    f.write("a", b"one\ntwo\nthree\n\nfour")
    f.write("b", b"x")
    assert sorted(f.batch()) == [("a", 0, 8, "three", True), ("a", 0, 15, "four", False), ("b", 0, 0, "x", False)]
    f.restart()
    assert f.batch() == []
    f.write("a", b"new\n")  # shorter: from its start
    f.write("b", b"y")  # changed, not longer
    assert sorted(f.batch()) == [("a", 1, 0, "new", True), ("b", 1, 0, "y", False)]
    os.remove(f.folder / "a")
    assert f.batch() == []
    f.write("a", b"back\n")
    assert f.batch() == [("a", 0, 0, "back", True)]


@pytest.mark.parametrize("piece", ["1", "7", "100", "1000000"])
def test_lines_of_pieces_are_the_lines_of_the_file(tmp_path, piece):
    rng = random.Random(int(piece))
    f = Files(tmp_path, piecebytes=piece)
    wanted, seen = {}, {}
    content = {n: b"" for n in "abcde"}
    for _ in range(75):  # beyond a snapshot
        for n in rng.sample("abcde", 2):
            content[n] += bytes(rng.choice(b"xy\n\xc3\xa9") for _ in range(rng.randint(1, 20)))
            f.write(n, content[n])
        for name, generation, start, line, whole in f.batch():
            if whole:
                assert (name, start) not in seen
                seen[name, start] = line
        if rng.random() < 0.2:
            f.restart()
    for n, data in content.items():
        at = 0
        for line in data.split(b"\n")[:-1]:
            if line.strip():
                wanted[n, at] = line.decode("utf-8", "replace")
            at += len(line) + 1
    assert seen == wanted
    assert len(os.listdir(tmp_path / "journal")) < 60


def test_batches_run_again_and_bounded(tmp_path):
    f = Files(tmp_path, maxbytespertrigger="10")
    for i in range(5):
        f.write(f"f{i}", b"12345678\n")
    sizes = []
    for _ in range(4):
        before = f.at
        rows = f.batch()
        again = [r for p in GrowingReader(f.options).partitions(before, f.at) for b in f.reader.read(p) for r in b.to_pylist()]
        assert len(again) == len(rows)
        sizes.append(len(rows))
    assert sizes == [2, 2, 1, 0]


def test_a_line_longer_than_all_pieces(tmp_path):
    data = b"a\n" + b"x" * 3_000_000 + b"\nb\n"
    (tmp_path / "f").write_bytes(data)
    from pyarrow import fs

    file = fs.LocalFileSystem().open_input_file(str(tmp_path / "f"))
    got = [(at, len(line)) for a in range(0, len(data), 500_000) for at, line in lines_in(file, a, min(a + 500_000, len(data)), a == 0, len(data))]
    assert got == [(0, 1), (2, 3_000_000), (3_000_003, 1)]


def line(**fields):
    return json.dumps(fields)


def at(minute):
    return f"2025-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"


CLAUDE = [line(type="user", timestamp=at(0), message={"content": "hi"}), line(type="assistant", timestamp=at(1), message={"content": [{"type": "tool_use", "id": "a", "name": "Bash"}, {"type": "tool_use", "id": "b", "name": "Read"}]}), line(type="user", timestamp=at(61), message={"content": [{"type": "tool_result", "tool_use_id": "a"}]}), line(type="assistant", timestamp=at(80), message={"content": "done"}), "not json", line(type="user", timestamp=at(200), message={"content": [{"type": "tool_result", "tool_use_id": "b"}]}), line(type="system", timestamp=at(202))]
CODEX = [line(timestamp=at(0), type="session_meta", payload={}), line(timestamp=at(1), type="response_item", payload={"type": "message", "role": "developer"}), line(timestamp=at(2), type="response_item", payload={"type": "message", "role": "user"}), line(timestamp=at(3), type="response_item", payload={"type": "function_call", "call_id": "c", "name": "exec_command"}), line(timestamp=at(4), type="response_item", payload={"type": "custom_tool_call", "call_id": "d", "name": "view_image"}), line(timestamp=at(60), type="response_item", payload={"type": "function_call_output", "call_id": "c"}), line(timestamp=at(70), type="response_item", payload={"type": "custom_tool_call_output", "call_id": "d"}), line(timestamp=at(71), type="response_item", payload={"type": "reasoning"}), line(timestamp=at(72), type="event_msg", payload={"type": "message", "role": "user"})]
FACTORY = [line(type="message", timestamp=at(0), message={"role": "user", "content": "hi"}), line(type="message", timestamp=at(1), message={"role": "assistant", "content": [{"type": "tool_use", "id": "a", "name": "Task"}]}), line(type="message", timestamp=at(9), message={"role": "user", "content": [{"type": "tool_result", "tool_use_id": "a"}]}), line(type="other", timestamp=at(10))]
GROK = [line(type="turn_started", ts=at(0)), line(type="first_token", ts=at(1)), line(type="tool_completed", timestamp=at(2), tool_name="run_terminal_cmd"), line(type="tool_completed", ts=at(3), tool_name="read_file"), line(type="phase_changed", ts=at(4))]
DSH = [line(type="session", createdAt=5, time=9), line(type="user/message", time=10, data={"source": {"kind": "user"}}), line(type="user/message", time=11, data={"source": {"kind": "hook"}}), line(type="assistant/message", time=12, data={"message": {"content": [{"type": "tool-call", "id": "a", "name": "bash"}, {"type": "text"}]}}), line(type="tool/result", time=13, data={"message": {"toolCallId": "a"}}), line(type="tool/result", time=14, data={"message": {"source": {"callId": "z"}}})]
KINDS = {"claude": (CLAUDE, [1, 2, 5, 2, 0, 3, 0]), "codex": (CODEX, [0, 0, 1, 2, 2, 5, 3, 2, 0]), "factory": (FACTORY, [1, 2, 5, 0]), "grok": (GROK, [1, 2, 5, 3, 0]), "dsh": (DSH, [0, 1, 0, 2, 5, 3])}


def lines_of(spark, rows):
    return spark.createDataFrame([("p", 0, i, x, True) for i, x in enumerate(rows)], "path string, generation int, start long, line string, whole boolean")


@pytest.mark.parametrize("source", sorted(KINDS))
def test_record_kinds(spark, source):
    rows, kinds = KINDS[source]
    found = spans.settled_kinds(spans.records(lines_of(spark, rows), source), order="start").orderBy("start").collect()
    assert [r["kind"] for r in found] == kinds
    assert [r["ms"] is None for r in found] == [x == "not json" for x in rows]
    if source == "dsh":
        assert [r["ms"] for r in found] == [5, 10, 11, 12, 13, 14]


def test_unknown_source(spark):
    with pytest.raises(ValueError, match="fx"):
        spans.records(lines_of(spark, []), "fx")


def follow(spark, tmp_path, source, forget=None):
    spark.dataSource.register(GrowingLines)
    got = {}

    def keep(batch, number):
        for r in batch.collect():
            got[os.path.basename(r["path"])] = r

    lines = spark.readStream.format("growing").option("path", str(tmp_path / "in")).option("journal", str(tmp_path / "journal")).load()
    with spans.with_state(spark):
        spans.growing_worked_time(lines, source, forget).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return got


def test_half_lines_count_on_a_copy(spark, tmp_path):
    (tmp_path / "in").mkdir()
    file, text = tmp_path / "in" / "f", "\n".join(CLAUDE) + "\n"
    batch = spans.settled_kinds(spans.records(lines_of(spark, CLAUDE), "claude"), order="start").withColumnRenamed("start", "seq")
    whole = timing.worked_time(batch).collect()[0]
    stops = [len("\n".join(CLAUDE[:3])), len("\n".join(CLAUDE[:3])) + 30, len(text)]
    shown = []
    for stop in stops:
        file.write_text(text[:stop])
        r = follow(spark, tmp_path, "claude")["f"]
        shown.append((r["active_ms"], r["n"], r["half"]))
    # the third line is whole JSON without its newline: it counts, and once
    assert shown == [(61 * 60_000, 3, True), (61 * 60_000, 4, True), (whole["active_ms"], 7, False)]
    assert r["at_message_ms"] == whole["at_message_ms"] and follow(spark, tmp_path, "claude") == {}
    file.write_text(CLAUDE[0] + "\n")  # anew
    r = follow(spark, tmp_path, "claude")["f"]
    assert (r["generation"], r["active_ms"], r["n"]) == (1, 0, 1)


def test_state_of_silent_sessions_goes(spark, tmp_path):
    rows = [(p, i, t, "user", None, None, False) for p, ts in (("old", [0, 60]), ("quiet", [90_000]), ("busy", [100_000, 100_001])) for i, t in enumerate(ts)]
    schema = "path string, seq long, t long, type string, tool_use_id string, stop string, interrupted boolean"
    spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    got = {}

    def keep(batch, number):
        for r in batch.collect():
            got[r["path"]] = (r["generating"], r["silent"])

    with spans.with_state(spark):
        spans.timed_generating(stream, idle_ms=5_000_000, forget_ms=50_000_000).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        left = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "turn").load()
        assert {r["key"]["path"] for r in left.collect()} == {"quiet", "busy"}
    assert got == {"old": (False, True), "quiet": (False, True), "busy": (True, False)}
