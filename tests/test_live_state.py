"""Live states by source against loops over the lines, and reads of file ends against whole files."""

import json
import random

import pytest

from weft.operators import live_state
from weft.sources import ends


def message(rng, source):
    ids = [f"t{rng.randrange(4)}" for _ in range(rng.randint(0, 2))]
    kind = rng.random()
    if kind < 0.4:
        content = [{"type": "tool_use", "id": i, "name": "Bash"} for i in ids] + [{"type": "text", "text": "x"}]
        m, type_ = {"role": "assistant", "content": content, "stop_reason": rng.choice([None, "end_turn", "tool_use", "max_tokens", "odd"])}, "assistant"
    elif kind < 0.8:
        content = rng.choice([[{"type": "tool_result", "tool_use_id": i} for i in ids], "go on", "[Request interrupted by user]", [{"type": "text", "text": "[Request interrupted by user for tool use]"}], [{"type": "tool_result"}]])
        m, type_ = {"role": "user", "content": content}, "user"
    else:
        return {"type": "system", "subtype": rng.choice(["turn_duration", "other"])}
    return {"type": type_ if source == "claude" else "message", "message": m}


def blocks(o):
    c = o.get("message", {}).get("content")
    return c if isinstance(c, list) else []


def of_messages(rows, source):
    pending, role, stop, unmatched = set(), None, None, False
    for o in rows:
        who = o["type"] if source == "claude" else o.get("message", {}).get("role")
        if source != "claude" and o["type"] != "message":
            continue
        ids = [b["id"] for b in blocks(o) if b["type"] == "tool_use"]
        if who == "assistant":
            role, stop, unmatched = who, o["message"]["stop_reason"] or ("tool_use" if ids else ""), bool(ids)
            pending |= set(ids)
        elif who == "user":
            results = [b for b in blocks(o) if b["type"] == "tool_result"]
            for b in results:
                pending.discard(b.get("tool_use_id"))
                if "tool_use_id" not in b:
                    pending.clear()
            unmatched = unmatched and not results
            role = "user"
            c = o["message"]["content"]
            if source == "claude" and ("[Request interrupted by user" in c if isinstance(c, str) else any(b.get("text", "").startswith("[Request interrupted by user") for b in c)):
                role, pending = "interrupted", set()
        elif o.get("subtype") == "turn_duration" and not stop and source == "claude":
            stop = "end_turn"
    if source == "claude":
        works = role == "user" or role == "assistant" and stop not in ("end_turn", "stop_sequence", "max_tokens")
    else:
        works = unmatched or role == "user"
    return bool(pending) or works, len(pending)


def turn(rng, source):
    if source == "codex":
        return rng.choice([{"type": "event_msg", "payload": {"type": rng.choice(["task_started", "task_complete", "turn_aborted", "agent_message"])}}, {"type": "response_item", "payload": {"type": rng.choice(["function_call", "custom_tool_call", "web_search_call", "reasoning"]), "status": rng.choice([None, "completed", "running"])}}, {"type": "response_item", "payload": {"type": "function_call_output"}}])
    return {"type": rng.choice(["turn_started", "turn_ended", "tool_started", "tool_completed", "phase_changed"]), "phase": rng.choice(["waiting_for_model", "streaming_text", "idle", "", None])}


def of_turns(rows, source):
    tasks = tools = 0
    boundary, busy = None, False
    for o in rows:
        kind = o.get("payload", {}).get("type") if source == "codex" else o["type"]
        if kind in ("task_started", "turn_started"):
            tasks, boundary, busy = tasks + (source == "codex"), "started", False
        elif kind in ("task_complete", "turn_aborted", "turn_ended"):
            tasks, boundary, busy = max(0, tasks - (source == "codex")), "ended", False
        elif kind in ("function_call", "custom_tool_call", "web_search_call") and o["payload"]["status"] != "completed" or kind == "tool_started":
            tools += 1
        elif kind in ("function_call_output", "tool_completed"):
            tools = max(0, tools - 1)
        elif kind == "phase_changed" and o["phase"]:
            busy = o["phase"].startswith(("waiting_for_model", "streaming_"))
    return tasks > 0 or tools > 0 or busy or boundary != "ended", tools


@pytest.mark.parametrize("source", ["claude", "factory", "codex", "grok"])
def test_states_equal_a_loop(spark, source):
    rng, rows, want = random.Random(source), [], {}
    make, judge = (message, of_messages) if source in ("claude", "factory") else (turn, of_turns)
    for p in range(150):
        objects = [make(rng, source) for _ in range(rng.randint(1, 9))]
        want[f"p{p}"] = judge(objects, source)
        rows += [(f"p{p}", i, json.dumps(o), False) for i, o in enumerate(objects)]
    rows += [("half", 0, json.dumps({"type": "turn_ended"}), True), ("half", 1, '{"type"', True)]
    got = {r["path"]: (r["generating"], r["pending"]) for r in live_state.generating(spark.createDataFrame(rows, "path string, seq long, line string, mid_write boolean"), source).collect()}
    assert got.pop("half")[0] is True and got == want and {g for g, _ in want.values()} == {True, False}


def test_cursor_and_unknown(spark):
    rows = [("a", 0, '{"role":"user"}', False), ("a", 1, '{"type":"turn_ended"}', False), ("b", 0, '{"type":"turn_ended"}', False), ("b", 1, '{"role":"assistant"}', False), ("c", 0, "{}", False)]
    df = spark.createDataFrame(rows, "path string, seq long, line string, mid_write boolean")
    assert {r["path"]: r["generating"] for r in live_state.generating(df, "cursor").collect()} == {"a": False, "b": True, "c": False}
    with pytest.raises(ValueError, match="pi"):
        live_state.generating(df, "pi")


def test_ends_of_files(spark, tmp_path):
    rng = random.Random(0)
    for i in range(30):
        lines = ["{}" if rng.random() < 0.2 else json.dumps({"x": "y" * rng.choice([0, 5, 50, 400])}) for _ in range(rng.randint(0, 12))]
        data = "\n".join(lines) + rng.choice(["", "\n", '\n{"half'])
        (tmp_path / f"f{i}").write_text(data)
        most, longest = rng.choice([10, 100, 1000, 10_000]), rng.choice([0, 300, 5000])
        starts, at = [], 0
        for line in data.encode().split(b"\n"):
            starts.append((at, line))
            at += len(line) + 1
        size = len(data.encode())
        with open(tmp_path / f"f{i}", "rb") as raw:
            from pyarrow import PythonFile

            file = PythonFile(raw, "r")
            got = ends.tail_of(file, most, max(most, longest))
            from_ = size - most
            reach = [s for s, _ in starts if s <= max(0, from_)][-1]
            first = 0 if from_ <= 0 else reach if size - reach <= max(most, longest) else from_ + 1
            assert got == [(s, x) for s, x in starts if s >= first and x.strip()], (i, most, longest)
            file.seek(0)
            assert ends.head_of(file, most) == [(s, x) for s, x in starts if x.strip() and (s + len(x) < most or size <= most)]
    df = spark.createDataFrame([(str(tmp_path / f"f{i}"),) for i in range(30)], "path string")
    tails = ends.tails(df).collect()
    for i in range(30):
        text = (tmp_path / f"f{i}").read_text()
        own = [r for r in tails if r["path"].endswith(f"/f{i}")]
        assert "\n".join(r["line"] for r in own) == "\n".join(x for x in text.split("\n") if x) and all(r["mid_write"] == text.endswith('{"half') for r in own)
    assert {r["line"] for r in ends.heads(df, 10).collect()} <= {"{}", '{"x": ""}', '{"half'}
