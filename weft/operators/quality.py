"""How well chapters went: efficiency, outcomes, tools, files, groups of calls.

A row of chapter facts has path, idx, tokens, n_files, files, commits, edits (edit and write calls), reads, calls, commands,
ok_commands, agents, thoughts, errors, retries, failed_retries (of groups that stay unresolved), fixes and outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import errors as E
from weft.functions.records import corrects, git_op, tool_kind
from weft.operators.insights import top


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def efficiency(chapters: DataFrame, key: str = "path") -> DataFrame:
    """``chapters`` with score (0 to 100), reasons (of waste), wasteful, tok_per_file, tok_per_commit, error_tokens and waste_tokens.

    What is a high number of tokens is told by the average chapter of the session.
    """
    c = F.col
    average = F.avg("tokens").over(Window.partitionBy(key))
    high = (c("tokens") > average * 1.5) & (average > 0)
    idle = (c("n_files") == 0) & (c("commits") == 0) & (c("edits") == 0) & (c("commands") == 0) & (c("agents") == 0)
    reasons = F.array_compact(F.array(
        F.when(high & idle, "high tokens, no file changes or actions"),
        F.when((c("failed_retries") >= 3) & (c("fixes") == 0), F.concat(c("failed_retries").cast("string"), F.lit(" failed retries without resolution"))),
        F.when((c("thoughts") > 0) & (c("calls") == 0), "reasoning with no tool actions"),
        F.when((c("errors") >= 3) & (c("fixes") == 0), F.concat(c("errors").cast("string"), F.lit(" errors, no self-correction"))),
        F.when((c("reads") >= 6) & (c("edits") == 0) & (c("commits") == 0) & high, "heavy reading with no edits"),
    ))
    each = lambda n, most, by: F.when(c("calls") > 0, F.least(F.lit(float(most)), c(n) / c("calls") * by)).otherwise(0.0)
    ratio = F.coalesce(F.try_divide(c("tokens"), average), F.lit(0.0))
    slow = F.when((ratio > 2) & (c("edits") + c("commits") + c("ok_commands") <= 1), F.least(F.lit(25.0), (ratio - 1) * 10)).otherwise(0.0)
    bonus = F.when((c("fixes") > 0) & (c("errors") > 0), F.least(F.lit(10.0), F.coalesce(F.try_divide(c("fixes"), c("errors")), F.lit(0.0)) * 10)).otherwise(0.0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), half_up(100 - each("errors", 40, 200) - each("retries", 25, 150) - slow + bonus)))
    per = lambda n: F.coalesce(half_up(F.try_divide(c("tokens"), c(n))), F.lit(0))
    scored = chapters.withColumns({"score": score, "reasons": reasons, "tok_per_file": per("n_files"), "tok_per_commit": per("commits"), "error_tokens": F.when(c("calls") > 0, half_up(c("tokens") * c("errors") / c("calls"))).otherwise(0)})
    wasteful = (F.size("reasons") > 0) | (c("score") < 40)
    return scored.withColumns({"wasteful": wasteful, "waste_tokens": F.when(wasteful, half_up(c("tokens") * F.greatest(F.lit(0.2), 1 - c("score") / 100))).otherwise(0)})


def overview(scored: DataFrame, key: str = "path") -> DataFrame:
    """(key, chapters, clean, corrected, struggling, errors, retries, fixes, commits, wasteful, waste_tokens, files)."""
    has = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    sums = scored.groupBy(key).agg(F.count("*").alias("chapters"), has("clean"), has("corrected"), has("struggling"), *(F.sum(c).alias(c) for c in ("errors", "retries", "fixes", "commits", "waste_tokens")), F.count_if("wasteful").alias("wasteful"))
    files = scored.select(key, F.explode("files").alias("file")).groupBy(key).agg(F.count_distinct("file").alias("files"))
    return sums.join(files, key, "left").withColumn("files", F.coalesce("files", F.lit(0)))


def tool_performance(calls: DataFrame, key: str = "path") -> DataFrame:
    """(tool, total, errors, retries, chapters) of calls (path, chapter, tool, failed, retry)."""
    return calls.groupBy("tool").agg(F.count("*").alias("total"), F.count_if("failed").alias("errors"), F.count_if("retry").alias("retries"), F.count_distinct(key, "chapter").alias("chapters"))


def file_hotspots(touches: DataFrame, key: str = "path", most: int = 30) -> DataFrame:
    """(key, file, touches, reads, edits, chapters, r): the files of a session touched most, of (path, chapter, file, op)."""
    sums = touches.groupBy(key, "file").agg(F.count("*").alias("touches"), F.count_if(F.col("op") == "read").alias("reads"), F.count_if(F.col("op") != "read").alias("edits"), F.count_distinct("chapter").alias("chapters"))
    return top(sums, [key], [F.desc("touches"), F.asc("file")], most)


def errors_by_tool(calls: DataFrame, key: str = "path", most: int = 6) -> DataFrame:
    """(key, tool, errors, r): the tools that fail most."""
    return top(calls.filter("failed").groupBy(key, "tool").agg(F.count("*").alias("errors")), [key], [F.desc("errors"), F.asc("tool")], most)


def corrected(prompts: DataFrame, key: str = "path", order: str = "chapter") -> DataFrame:
    """``prompts`` with corrected: the next prompt of the session takes this one's work back."""
    following = F.lead("prompt").over(Window.partitionBy(key).orderBy(F.asc_nulls_last(order)))
    return prompts.withColumn("corrected", F.coalesce(corrects(following), F.lit(False)))


def tool_groups(blocks: DataFrame, key: str = "path", order: str = "ord") -> DataFrame:
    """(key, start, kind, rows, thoughts, failed): runs of calls of one kind, of (path, ord, block, tool, failed).

    ``block`` is tool, thought or anything else. Thoughts between two calls of one kind belong to their run; other
    blocks end it.
    """
    kind = F.when(F.col("block") == "tool", tool_kind(F.col("tool"))).when(F.col("block") != "thought", "-")
    w = Window.partitionBy(key).orderBy(order)
    last = F.last("kind", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    following = F.first("kind", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    known = blocks.withColumn("kind", kind).withColumns({"last": last, "following": following})
    inside = known.filter("kind <> '-' or (kind is null and last = following and last <> '-')")
    begins = (F.col("kind").isNotNull() & ~F.col("kind").eqNullSafe(F.col("last"))).cast("int")
    run = inside.withColumn("run", F.sum(begins).over(w))
    return run.groupBy(key, "run").agg(F.min(order).alias("start"), F.max("kind").alias("kind"), F.count("kind").alias("rows"), F.count_if(F.col("kind").isNull()).alias("thoughts"), F.count_if(F.coalesce("failed", F.lit(False))).alias("failed")).drop("run")


def session_index(steps: DataFrame, key: str = "path") -> DataFrame:
    """One row for each session of ``steps`` (``weft.operators.analysis``): what lists and searches show of it.

    key, n_events, first_ms, last_ms, chapters, turns, calls, errors, commits, tools (in order of first use), tool_counts,
    files (distinct inputs of file tools) and first_prompt.
    """
    call = F.col("type") == "call"
    tools = steps.filter(call).groupBy(key, "tool").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    tools = tools.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "tool"))), lambda x: x["tool"]).alias("tools"), F.map_from_entries(F.collect_list(F.struct("tool", "n"))).alias("tool_counts"))
    touched = F.when(call & F.coalesce(F.col("tool"), F.lit("")).rlike(E.FILE_TOOL), F.col("input"))
    commit = call & F.coalesce(F.col("tool"), F.lit("")).rlike(E.SHELL_TOOL) & (git_op(F.col("input"), F.lit(""))["type"] == "commit")
    failed = (F.col("type") == "tool_result") & F.coalesce("is_error", F.lit(False))
    sums = steps.groupBy(key).agg(
        F.count("*").alias("n_events"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.count_if(F.col("type") == "user").alias("chapters"), F.count_if(F.col("type") == "assistant").alias("turns"), F.count_if(call).alias("calls"), F.count_if(failed).alias("errors"),
        F.count_if(F.coalesce(commit, F.lit(False))).alias("commits"), F.count_distinct(touched).alias("files"), F.min_by("text", F.when(F.col("type") == "user", F.col("seq"))).alias("first_prompt"),
    )
    return sums.join(tools, key, "left")


def summaries(sessions: DataFrame, index: DataFrame, parsed: DataFrame, figures: list[str], key: str = "path", version: str = "mtime") -> DataFrame:
    """One row for each session: the index's figures if its row is of the session's version, else those of the parse.

    ``from_index`` says which; a session in neither has null figures.
    """
    current = index.select(key, version, *(F.col(f).alias(f"index_{f}") for f in figures), F.lit(True).alias("current"))
    own = parsed.select(key, *(F.col(f).alias(f"parsed_{f}") for f in figures))
    both = sessions.join(current, [key, version], "left").join(own, key, "left")
    return both.select(key, version, *(F.when(F.col("current"), F.col(f"index_{f}")).otherwise(F.col(f"parsed_{f}")).alias(f) for f in figures), F.coalesce("current", F.lit(False)).alias("from_index"))


def usage(rows: DataFrame, key: str = "path", fields: tuple[str, ...] = ("input", "output")) -> DataFrame:
    """Sums per session of usage rows (request_id, message_id): a request's rows are cumulative, so its largest counts.

    Rows that lack either id stand for themselves.
    """
    named = F.col("request_id").isNotNull() & F.col("message_id").isNotNull()
    once = rows.filter(named).groupBy(key, "request_id", "message_id").agg(*(F.max(f).alias(f) for f in fields)).select(key, *fields)
    return once.unionByName(rows.filter(~named).select(key, *fields)).groupBy(key).agg(*(F.sum(f).alias(f) for f in fields), F.count("*").alias("requests"))


def growth(rows: DataFrame, counter: str, key: str = "path", order: str = "seq") -> DataFrame:
    """``rows`` with grown: how far a cumulative counter rose; one that falls was reset and counts from zero."""
    last = F.coalesce(F.lag(counter).over(Window.partitionBy(key).orderBy(order)), F.lit(0))
    return rows.withColumn("grown", F.when(F.col(counter) >= last, F.col(counter) - last).otherwise(F.col(counter)))


def estimated_tokens(turns: DataFrame, key: str = "path") -> DataFrame:
    """(key, tokens, estimated): reported tokens, or a quarter of the characters where a session reports none.

    ``turns`` has chars and output; a turn counts 1 at least.
    """
    guess = F.greatest(F.lit(1), half_up(F.col("chars") / 4))
    sums = turns.groupBy(key).agg(F.sum(F.coalesce("output", F.lit(0))).alias("reported"), F.sum(guess).alias("guessed"))
    return sums.select(key, F.when(F.col("reported") > 0, F.col("reported")).otherwise(F.col("guessed")).alias("tokens"), (F.col("reported") == 0).alias("estimated"))


def within_budget(chunks: DataFrame, budget: int, key: str = "path", order: str = "seq") -> DataFrame:
    """Distinct chunks of each session, the first of equal ones, as far as ``budget`` characters go; the last is cut."""
    first = chunks.groupBy(key, "chunk").agg(F.min(order).alias(order))
    before = F.coalesce(F.sum(F.length("chunk")).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("left", budget - before).filter("left > 0").select(key, order, F.substring("chunk", F.lit(1), F.col("left").cast("int")).alias("chunk"))
