"""Chapters as rows: what a prompt led to, found again by what was said, called, answered or touched; rows for lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.ragged import strings_of
from weft.functions.records import first_field
from weft.functions.text import session_hash, short_path

# What a chapter before any prompt is called, tools whose input names a file, sources whose recordings tell
# a duration.
NO_PROMPT = "(subagent session)"
FILE_TOOLS = ("Read", "Edit", "Write", "Delete")
TIMED = ("claude", "codex", "factory", "grok", "vktr", "opencode", "fx", "dsh")
LONG, FIRST, CUT = 20, 5, 300


def numbered(events: DataFrame) -> DataFrame:
    """``events`` with chapter: counted up at each prompt, 0 from the first assistant turn before any; what comes before
    both is in no chapter and left out."""
    upto = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    said = (F.col("type") == "user") & (F.coalesce("text", F.lit("")) != "")
    marked = events.withColumns({"chapter": F.sum(said.cast("int")).over(upto), "begun": F.max(F.col("type") == "assistant").over(upto)})
    return marked.filter("chapter > 0 or begun").drop("begun")


def _calls(events: DataFrame) -> DataFrame:
    return events.filter("type = 'assistant'").select("path", "chapter", "seq", F.posexplode("tool_calls").alias("at", "call")).select("path", "chapter", "seq", "at", "call.id", "call.name", "call.input")


def chapter_table(events: DataFrame) -> DataFrame:
    """One row for each chapter of events (path, seq, type, ts, text, tool_calls, tool_use_id, is_error, usage).

    prompt, started, ended (the last turn), turns, tokens_in, tokens_out, cache_read, last_text, tool_counts, files (to
    the tools that touched them, in order), errors, error_tools (by the tool whose call failed, wherever in the session
    it stands) and standalone (the first errors that answer no call).
    """
    rows, key = numbered(events), ["path", "chapter"]
    assistant, said = F.col("type") == "assistant", F.coalesce("text", F.lit("")) != ""
    failed = (F.col("type") == "tool_result") & F.coalesce("is_error", F.lit(False))
    asked = (F.col("type") == "user") & said
    at = lambda when: F.when(when, F.col("seq"))
    opening = F.min_by("text", at(assistant & (F.length("text") > LONG)))
    alone = F.when(failed & F.col("tool_use_id").isNull(), F.struct("seq", F.substring(F.coalesce(F.nullif("text", F.lit("")), F.lit("(unknown error)")), 1, CUT).alias("text")))
    sums = rows.groupBy(*key).agg(
        F.min_by("text", at(asked)).alias("asked"), opening.alias("opening"), F.min_by("ts", at(asked | assistant)).alias("started"), F.max_by("ts", at(assistant)).alias("ended"), F.count_if(assistant).alias("turns"),
        *(F.coalesce(F.sum(F.when(assistant, F.col(f"usage.{c}"))), F.lit(0)).alias(n) for c, n in (("input", "tokens_in"), ("output", "tokens_out"), ("cache_read", "cache_read"))),
        F.max_by("text", at(assistant & said)).alias("last_text"), F.count_if(failed).alias("errors"), F.slice(F.array_sort(F.collect_list(alone)), 1, FIRST).alias("standalone"),
    )
    calls = _calls(rows)
    counts = calls.groupBy(*key, "name").agg(F.count("*").alias("n")).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("tool_counts"))
    file = short_path(first_field(F.col("input"), ["file_path", "path", "target_file", "filePath"]))
    touched = calls.filter(F.col("name").isin(*FILE_TOOLS)).withColumn("file", file).filter("file is not null")
    ops = touched.groupBy(*key, "file").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "at", "name"))), lambda x: x["name"]).alias("ops"))
    files = ops.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("file", "ops"))).alias("files"))
    named = calls.filter("id is not null").groupBy("path", "id").agg(F.max_by("name", F.struct("seq", "at")).alias("name"))
    blamed = rows.filter(failed).select(*key, F.col("tool_use_id").alias("id")).join(named, ["path", "id"]).groupBy(*key, "name").agg(F.count("*").alias("n"))
    blamed = blamed.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("error_tools"))
    whole = sums.join(counts, key, "left").join(files, key, "left").join(blamed, key, "left")
    empty = lambda c, kind: F.coalesce(c, F.create_map().cast(kind)).alias(c)
    prompt = F.coalesce("asked", "opening", F.lit(NO_PROMPT)).alias("prompt")
    return whole.select(*key, prompt, "started", "ended", "turns", "tokens_in", "tokens_out", "cache_read", "last_text", empty("tool_counts", "map<string,long>"), empty("files", "map<string,array<string>>"), "errors", empty("error_tools", "map<string,long>"), F.transform("standalone", lambda x: x["text"]).alias("standalone"))


def chapters_holding(events: DataFrame, words: str) -> DataFrame:
    """(path, chapter) of the chapters that hold ``words`` in any case: in the prompt or a reply, a result, a tool's name
    (and so its server and method), or anywhere in what a call was given (commands, queries, addresses, file paths, old and
    new text, prompts of agents, parameters), as it was written, not as JSON escapes it."""
    low = words.lower()
    holds = lambda c: F.coalesce(F.lower(c).contains(low), F.lit(False))
    rows = numbered(events)
    plain = rows.filter(holds(F.col("text"))).select("path", "chapter")
    calls = _calls(rows).withColumn("shown", holds(F.col("name")) | F.when(~F.col("input").contains("\\"), holds(F.col("input"))).otherwise(False))
    hidden = F.exists(strings_of(F.when(F.col("input").contains("\\"), F.col("input"))), lambda s: F.lower(s).contains(low))
    inside = calls.filter(F.col("shown") | F.coalesce(hidden, F.lit(False))).select("path", "chapter")
    return plain.unionByName(inside).distinct()


def api_rows(sessions: DataFrame, index: DataFrame) -> DataFrame:
    """The rows that lists are made of: sessions (path, source, project, size, mtime, title, host) with their index row.

    A session without an index row has its title for a prompt, no model, no tools and zeros. A duration is shown for
    sources whose recordings are timed.
    """
    both = sessions.join(index.withColumn("indexed", F.lit(True)), "path", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    hash_ = session_hash(F.col("path"))
    source = F.coalesce("source", F.lit("claude"))
    prompt = F.coalesce(F.nullif("first_prompt", F.lit("")), F.nullif("title", F.lit("")), F.lit(""))
    return both.select(
        "path", hash_.alias("session_hash"), source.alias("source"), F.col("project").alias("project_raw"), hash_.alias("id"), F.floor(F.col("size") / 1024).alias("size_kb"), "mtime", prompt.alias("prompt"), F.coalesce("model", F.lit("")).alias("model"),
        F.coalesce("tools", F.array().cast("array<string>")).alias("tools"), *(number(c).alias(c) for c in ("chapters", "input", "output", "cache_read", "total", "errors", "files", "commits")), F.when(source.isin(*TIMED), number("worked_ms")).alias("duration_ms"), "host",
    )


def diff_summary(text: Column) -> Column:
    """(files, added, removed) of a unified diff; null for other texts. A file that is gone has its old name."""
    lines = F.split(text, "\r?\n")
    name = lambda x: F.regexp_replace(F.regexp_replace(F.substring(x, 5, 10_000), r"\t.*$", ""), "^[ab]/", "")
    headers = F.filter(F.arrays_zip(lines.alias("a"), F.concat(F.slice(lines, 2, 1_000_000_000), F.array(F.lit(""))).alias("b")), lambda x: x["a"].startswith("--- ") & x["b"].startswith("+++ "))
    files = F.transform(headers, lambda x: F.when(F.substring(x["b"], 5, 9) == "/dev/null", name(x["a"])).otherwise(name(x["b"])))
    # a header's two lines begin with the signs as well
    count = lambda mark: F.size(F.filter(lines, lambda x: x.startswith(mark))) - F.size(headers)
    return F.when(F.size(headers) > 0, F.struct(files.alias("files"), count("+").alias("added"), count("-").alias("removed")))
