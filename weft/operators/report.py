"""A session as a Markdown report: what it was, what it took, and its chapters with files, commands, errors and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.money import cost
from weft.functions.records import first_field
from weft.functions.text import compact_number, dollars, duration_text, first_lines, one_line, session_hash
from weft.operators.chapter_table import _calls, chapter_table, numbered

# How much of a prompt, of commands, of their output, of errors and of a reply a report shows.
PROMPT_LINES, COMMANDS, OUTPUT_LINES, ERRORS, REPLY, COMMAND, OUTPUT = 10, 12, 4, 5, 800, 120, 300


def commands(events: DataFrame) -> DataFrame:
    """(path, chapter, shown, more, failed): the first commands of each chapter with ok and output, how many others there
    are, and the first that failed. A call's result is the session's latest with its id."""
    rows = numbered(events)
    results = rows.filter("type = 'tool_result' and tool_use_id is not null").groupBy("path", F.col("tool_use_id").alias("id")).agg(F.max_by(F.struct(F.coalesce("is_error", F.lit(False)).alias("bad"), F.coalesce("text", F.lit("")).alias("text")), "seq").alias("r"))
    ran = _calls(rows).filter("name = 'Bash'").withColumn("command", first_field(F.col("input"), ["command", "cmd"])).filter("command is not null")
    known = ran.join(results, ["path", "id"], "left").select("path", "chapter", "seq", "at", "command", F.coalesce("r.bad", F.lit(False)).alias("bad"), F.substring(F.coalesce("r.text", F.lit("")), 1, OUTPUT).alias("output"))
    order = Window.partitionBy("path", "chapter").orderBy("seq", "at")
    placed = known.withColumns({"n": F.row_number().over(order), "nth_bad": F.sum(F.col("bad").cast("int")).over(order)})
    item = F.struct("n", "command", "bad", "output")
    return placed.groupBy("path", "chapter").agg(
        F.array_sort(F.collect_list(F.when(F.col("n") <= COMMANDS, item))).alias("shown"), F.greatest(F.count("*") - COMMANDS, F.lit(0)).alias("more"), F.array_sort(F.collect_list(F.when(F.col("bad") & (F.col("nth_bad") <= ERRORS), item))).alias("failed"),
    )


def _section(title: str, body: Column, wanted: Column) -> Column:
    return F.when(F.coalesce(wanted, F.lit(False)), F.concat(F.lit(f"### {title}\n\n"), body, F.lit("\n\n"))).otherwise("")


def _counted_ops(ops: Column) -> Column:
    """Operations in the order of their first use, with how often."""
    return F.array_join(F.transform(F.array_distinct(ops), lambda o: F.concat(F.lower(o), F.when(F.size(F.filter(ops, lambda x: x == o)) > 1, F.concat(F.lit(" x"), F.size(F.filter(ops, lambda x: x == o)).cast("string"))).otherwise(""))), ", ")


def chapter_sections(events: DataFrame) -> DataFrame:
    """(path, chapter, markdown) of each chapter."""
    c = chapter_table(events).join(commands(events), ["path", "chapter"], "left")
    number = F.row_number().over(Window.partitionBy("path").orderBy("chapter"))
    lines = F.split("prompt", "\n")
    quoted = F.concat(F.array_join(F.transform(F.slice(lines, 1, PROMPT_LINES), lambda x: F.concat(F.lit("> "), x)), "\n"), F.when(F.size(lines) > PROMPT_LINES, "\n> ...").otherwise(""), F.lit("\n\n"))
    span = F.unix_millis("ended") - F.unix_millis("started")
    about = F.concat_ws(" | ", F.when(F.col("turns") > 0, F.concat(F.col("turns").cast("string"), F.when(F.col("turns") == 1, " turn").otherwise(" turns"))), F.when(span > 1000, duration_text(span)))
    files = F.array_join(F.transform(F.array_sort(F.map_entries("files")), lambda x: F.concat(F.lit("- `"), x["key"], F.lit("` — "), _counted_ops(x["value"]))), "\n")
    fenced = lambda x: F.when(x != "", F.concat(F.lit("\n\n```\n"), first_lines(x, OUTPUT_LINES), F.lit("\n```"))).otherwise("")
    ran = F.array_join(F.transform("shown", lambda x: F.concat(F.lit("**["), F.when(x["bad"], "FAIL").otherwise("ok"), F.lit("]** `"), F.substring(one_line(x["command"]), 1, COMMAND), F.lit("`"), fenced(x["output"]))), "\n\n")
    ran = F.concat(ran, F.when(F.col("more") > 0, F.concat(F.lit("\n\n*...and "), F.col("more").cast("string"), F.lit(" more commands*"))).otherwise(""))
    failed = F.transform("failed", lambda x: F.concat(F.lit("- `"), F.substring(x["command"], 1, COMMAND), F.lit("`"), F.when(x["output"] != "", F.concat(F.lit("\n  > "), F.substring(first_lines(x["output"], 1), 1, COMMAND))).otherwise("")))
    alone = F.transform("standalone", lambda x: F.concat(F.lit("- **session:** "), F.substring(first_lines(x, 1), 1, 200)))
    errors = F.slice(F.concat(F.coalesce(failed, F.array().cast("array<string>")), alone), 1, ERRORS)
    body = F.concat(
        F.lit("## Chapter "), number.cast("string"), F.lit("\n\n"), quoted, F.when(about != "", F.concat(F.lit("*"), about, F.lit("*\n\n"))).otherwise(""), _section("Files", files, F.size("files") > 0), _section("Commands", ran, F.size("shown") > 0),
        _section("Errors", F.array_join(errors, "\n"), F.size(errors) > 0), _section("Response", F.substring("last_text", 1, REPLY), F.col("last_text").isNotNull()), F.lit("---\n"),
    )
    return c.select("path", "chapter", body.alias("markdown"))


def session_reports(events: DataFrame, index: DataFrame) -> DataFrame:
    """(path, markdown) of each session of ``events`` with an index row (``recorded_index`` and source).

    Lines of the header that have nothing to say are left out. A chapter's text is made where its rows are; only the
    finished chapters of a session meet.
    """
    counts = F.array_sort(F.map_entries("tool_counts"), lambda a, b: F.when(a["value"] != b["value"], F.when(a["value"] > b["value"], -1).otherwise(1)).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    calls = F.aggregate(F.map_values("tool_counts"), F.lit(0).cast("long"), lambda a, x: a + x)
    spent = dollars(cost(F.col("model"), F.col("total") - F.col("output"), F.col("output"), F.col("cache_read"), F.lit(0), F.lit(0)))
    line = lambda name, value, wanted: F.when(F.coalesce(wanted, F.lit(False)), F.concat(F.lit(f"**{name}:** "), value))
    point = lambda name, value, wanted=None: F.when(F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False)), F.concat(F.lit(f"- **{name}:** "), value))
    about = F.concat_ws("  \n", line("Model", F.col("model"), F.coalesce("model", F.lit("")) != ""), line("Source", F.col("source"), F.col("source").isNotNull()), line("Duration", duration_text(F.col("worked_ms")), F.col("worked_ms") > 0), line("Estimated cost", spent, spent != ""))
    tokens = F.concat(compact_number(F.col("total")), F.lit(" ("), compact_number(F.col("total") - F.col("output")), F.lit(" in, "), compact_number(F.col("output")), F.lit(" out)"))
    tools = F.array_join(F.transform(counts, lambda x: F.concat(x["key"], F.lit(" ("), x["value"].cast("string"), F.lit(")"))), ", ")
    turns = numbered(events).groupBy("path").agg(F.count_if(F.col("type") == "assistant").alias("turns"))
    known = index.join(turns, "path", "left")
    summary = F.concat_ws("\n", point("Prompts", F.col("chapters").cast("string")), point("Turns", F.coalesce("turns", F.lit(0)).cast("string")), point("Tool calls", calls.cast("string")), point("Tokens", tokens, F.col("total") > 0), point("Errors", F.col("errors").cast("string"), F.col("errors") > 0), point("Tools", tools, calls > 0))
    head = F.concat(F.lit("# Session "), session_hash(F.col("path")), F.lit("\n\n"), about, F.lit("\n\n## Summary\n\n"), summary, F.lit("\n\n---\n\n"))
    chapters = chapter_sections(events).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter", "markdown"))), lambda x: x["markdown"]), "\n").alias("body"))
    return known.withColumn("head", head).join(chapters, "path", "left").select("path", F.concat("head", F.coalesce("body", F.lit(""))).alias("markdown"))
