"""Sessions as messages that a model can be sent again, as hand-offs and as short reports.

Events have path, seq, type (user, assistant, tool_result), text, tool_calls (array of id, name, input as JSON),
tool_use_id and is_error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.insights import top

NO_OUTPUT = "(no output recorded)"


def _answered(events: DataFrame) -> DataFrame:
    """``events`` with open: the ids of its calls that no result of the session answers."""
    results = events.filter("type = 'tool_result' and tool_use_id is not null").select("path", F.col("tool_use_id").alias("id")).distinct()
    calls = events.filter("type = 'assistant'").select("path", "seq", F.posexplode("tool_calls").alias("at", "call")).select("path", "seq", "at", "call.id")
    missing = calls.join(results, ["path", "id"], "left_anti").groupBy("path", "seq").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("open"))
    return events.join(missing, ["path", "seq"], "left").withColumn("open", F.transform("open", lambda x: x["id"]))


def _session_error(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", "[session error]").otherwise(F.concat(F.lit("[session error] "), text))


def anthropic_messages(events: DataFrame) -> DataFrame:
    """(path, message, role, blocks, content): messages in order; ``content`` is the JSON array of the blocks.

    What a user says and results of tools join into one message until the assistant speaks; each assistant turn is a
    message. A call without a result gets a stub, and an error that answers no call is text, so the messages are valid.
    """
    block = lambda **f: F.struct(*(f.get(n, F.lit(None).cast(t)).cast(t).alias(n) for n, t in (("type", "string"), ("text", "string"), ("id", "string"), ("name", "string"), ("input", "variant"), ("tool_use_id", "string"), ("content", "string"), ("is_error", "boolean"))))
    part = lambda n, role, b: F.struct(F.lit(n).alias("n"), F.lit(role).alias("role"), b.alias("block"))
    said = F.coalesce(F.col("text"), F.lit(""))
    text = block(type=F.lit("text"), text=F.col("text"))
    made = F.transform(F.coalesce("tool_calls", F.array().cast("array<struct<id:string,name:string,input:string>>")), lambda c: part(1, "assistant", block(type=F.lit("tool_use"), id=c["id"], name=F.coalesce(c["name"], F.lit("unknown")), input=F.coalesce(F.try_parse_json(c["input"]), F.parse_json(F.lit("{}"))))))
    stubs = F.transform(F.coalesce("open", F.array().cast("array<string>")), lambda i: part(2, "user", block(type=F.lit("tool_result"), tool_use_id=i, content=F.lit(NO_OUTPUT))))
    result = part(0, "user", block(type=F.lit("tool_result"), tool_use_id=F.col("tool_use_id"), content=said, is_error=F.when(F.col("is_error"), F.lit(True))))
    parts = (
        F.when((F.col("type") == "user") & (said != ""), F.array(part(0, "user", text)))
        .when(F.col("type") == "assistant", F.concat(F.when(said != "", F.array(part(0, "assistant", text))).otherwise(F.slice(F.array(part(0, "assistant", text)), 1, 0)), made, stubs))
        .when((F.col("type") == "tool_result") & F.col("tool_use_id").isNull(), F.array(part(0, "user", block(type=F.lit("text"), text=_session_error(F.col("text"))))))
        .when(F.col("type") == "tool_result", F.array(result))
    )
    rows = _answered(events).select("path", "seq", F.posexplode(parts).alias("at", "p")).select("path", "seq", "at", "p.role", "p.block")
    w = Window.partitionBy("path").orderBy("seq", "at")
    flip = (F.col("role") != F.lag("role").over(w)) | ((F.col("role") == "assistant") & (F.col("seq") != F.lag("seq").over(w)))
    islands = rows.withColumn("flip", F.coalesce(flip, F.lit(True)).cast("int")).withColumn("message", F.sum("flip").over(w))
    found = islands.groupBy("path", "message", "role").agg(F.collect_list(F.struct("seq", "at", F.to_json("block").alias("json"))).alias("parts"))
    ordered = F.sort_array("parts")
    return found.select("path", "message", "role", F.size("parts").alias("blocks"), F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["json"]), ","), F.lit("]")).alias("content"))


def openai_messages(events: DataFrame, system: str | None = None) -> DataFrame:
    """(path, message, role, content): each turn and each result is a message of its own, as JSON."""
    kind = "struct<role:string,content:string,tool_call_id:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>>"
    fields = (("role", "string"), ("content", "string"), ("tool_call_id", "string"), ("tool_calls", "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"))
    message = lambda **f: F.struct(*(f.get(n, F.lit(None).cast(t)).cast(t).alias(n) for n, t in fields))
    said = F.coalesce(F.col("text"), F.lit(""))
    calls = F.transform("tool_calls", lambda c: F.struct(c["id"].alias("id"), F.lit("function").alias("type"), F.struct(F.coalesce(c["name"], F.lit("unknown")).alias("name"), F.coalesce(c["input"], F.lit("{}")).alias("arguments")).alias("function")))
    turn = message(role=F.lit("assistant"), content=F.nullif(said, F.lit("")), tool_calls=F.when(F.size("tool_calls") > 0, calls))
    stubs = F.transform(F.coalesce("open", F.array().cast("array<string>")), lambda i: message(role=F.lit("tool"), tool_call_id=i, content=F.lit(NO_OUTPUT)))
    parts = (
        F.when((F.col("type") == "user") & (said != ""), F.array(message(role=F.lit("user"), content=F.col("text"))))
        .when((F.col("type") == "assistant") & ((said != "") | (F.coalesce(F.size("tool_calls"), F.lit(0)) > 0)), F.concat(F.array(turn), stubs))
        .when((F.col("type") == "tool_result") & F.col("tool_use_id").isNull(), F.array(message(role=F.lit("user"), content=_session_error(F.col("text")))))
        .when(F.col("type") == "tool_result", F.array(message(role=F.lit("tool"), tool_call_id=F.col("tool_use_id"), content=said)))
    )
    rows = _answered(events).select("path", "seq", F.posexplode(parts.cast(f"array<{kind}>")).alias("at", "m"))
    if system:
        rows = rows.unionByName(events.select("path").distinct().select("path", F.lit(-(2**62)).alias("seq"), F.lit(0).alias("at"), message(role=F.lit("system"), content=F.lit(system)).alias("m")))
    number = F.row_number().over(Window.partitionBy("path").orderBy("seq", "at"))
    return rows.select("path", number.cast("long").alias("message"), "m.role", F.to_json("m").alias("content"))


def search_handoff(found: DataFrame, query: str, most: int = 5) -> DataFrame:
    """One row: a short text in Markdown on the first ``most`` results (r, path, project, snippets)."""
    entry = F.concat(F.lit("## "), F.col("r").cast("string"), F.lit(". "), F.coalesce("project", F.lit("(unknown)")), F.lit("\n\n`"), "path", F.lit("`\n"), F.array_join(F.transform("snippets", lambda s: F.concat(F.lit("\n> "), s)), ""))
    parts = F.array_sort(F.collect_list(F.struct("r", entry.alias("text"))))
    return found.filter(F.col("r") <= most).agg(F.concat(F.lit(f"# Results for {query}\n\n"), F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n")).alias("markdown"))


def standup(sessions: DataFrame, chapters: DataFrame, most_sessions: int = 20, most_chapters: int = 8, most_chars: int = 300) -> DataFrame:
    """(r, path, title, lines): the newest sessions with the latest chapters of each, every string cut to ``most_chars``."""
    newest = sessions.orderBy(F.desc("mtime"), "path").limit(most_sessions)
    ranked = newest.withColumn("r", F.row_number().over(Window.orderBy(F.desc("mtime"), "path")))  # at most most_sessions rows
    latest = top(chapters.join(F.broadcast(ranked.select("path")), "path", "left_semi"), ["path"], [F.desc("idx")], most_chapters)
    lines = latest.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.substring("prompt", 1, most_chars).alias("p")))), lambda x: x["p"]).alias("lines"))
    return ranked.join(lines, "path", "left").select("r", "path", F.substring("title", 1, most_chars).alias("title"), "lines")
