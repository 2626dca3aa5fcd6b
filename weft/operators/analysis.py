"""What many analysed sessions say together, and what one session's calls and results say.

A row of facts is one session: path, ord (its place in the list), source, host, area, analyzed (false: not analysed yet),
calls, errors, suspect, classes (map of error class to count), retries, loops, loop_calls, stalls, stall_ms,
longest_stall_ms, traps (map of trap to struct<n, ms>), active_ms, tokens and cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import errors as E
from weft.functions.records import path_bleed, repo_area, target_dirs
from weft.operators.insights import top
from weft.operators.timing import MODEL_WAIT, STALL, TOOL_WAIT_MOST

TEST_HANG = 600_000


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def totals(facts: DataFrame) -> DataFrame:
    """One row. Sessions, pending ones and worked time cover all rows, everything else the analysed ones."""
    own = lambda c: F.sum(F.when(F.col("analyzed"), F.col(c)).otherwise(0))
    sums = facts.agg(
        F.count("*").alias("sessions"), F.count_if("analyzed").alias("analyzed"), F.count_if(~F.col("analyzed")).alias("pending"),
        F.count_distinct(F.when(F.col("analyzed"), F.coalesce("host", F.lit("local")))).alias("hosts"), *(F.coalesce(own(c), F.lit(0)).alias(c) for c in ("calls", "errors", "suspect", "tokens", "cost")),
        F.count_if(F.col("analyzed") & (F.col("errors") > 0)).alias("error_sessions"), F.coalesce(F.sum("active_ms"), F.lit(0)).alias("active_ms"),
    )
    return sums.withColumn("error_rate", rate(F.col("errors"), F.col("calls")))


def _examples(rows: DataFrame, by: list[str], amount: str, most: int = 5) -> DataFrame:
    """(by, examples): the paths with most of ``amount``, in the order of a stable sort; only those rows are kept."""
    best = top(rows, by, [F.desc(amount), F.asc("ord")], most)
    return best.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]).alias("examples"))


def class_report(facts: DataFrame) -> DataFrame:
    """(class, n, sessions, share, examples) of error classes over the analysed sessions."""
    done = facts.filter("analyzed")
    found = done.select("path", "ord", F.explode("classes").alias("class", "n"))
    sums = found.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("sessions"))
    return sums.join(_examples(found, ["class"], "n"), "class").crossJoin(F.broadcast(done.agg(F.sum("errors").alias("all")))).withColumn("share", rate(F.col("n"), F.col("all"))).drop("all")


def group_report(facts: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(grouping, value, sessions, error_sessions, calls, errors, rate, top_classes, worst) of the groups with most calls.

    ``limits`` names the groupings, with how many groups of each to report; rows without a value are in no group.
    """
    done = facts.filter("analyzed").withColumn("host", F.coalesce("host", F.lit("local")))
    pairs = F.explode(F.array(*(F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("value")) for g in limits)))
    long = done.select("path", "ord", "calls", "errors", "classes", pairs.alias("g")).select("g.*", "path", "ord", "calls", "errors", "classes").filter("value is not null")
    key = ["grouping", "value"]
    sums = long.groupBy(*key).agg(F.count("*").alias("sessions"), F.count_if(F.col("errors") > 0).alias("error_sessions"), F.sum("calls").alias("calls"), F.sum("errors").alias("errors"))
    most = F.element_at(F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)), F.col("grouping"))
    sums = top(sums, ["grouping"], [F.desc("calls"), F.asc("value")], max(limits.values())).filter(F.col("r") <= most)
    classes = long.select(*key, F.explode("classes").alias("class", "n")).groupBy(*key, "class").agg(F.sum("n").alias("n"))
    best = top(classes, key, [F.desc("n"), F.asc("class")], 3).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "class"))), lambda x: x["class"]).alias("top_classes"))
    worst = _examples(long.filter("errors > 0"), key, "errors").withColumnRenamed("examples", "worst")
    return sums.withColumn("rate", rate(F.col("errors"), F.col("calls"))).join(best, key, "left").join(worst, key, "left")


def trap_report(facts: DataFrame) -> DataFrame:
    """(trap, sessions, events, ms, examples) over the analysed sessions."""
    found = facts.filter("analyzed").select("path", "ord", F.explode("traps").alias("trap", "t")).select("path", "ord", "trap", "t.n", "t.ms").filter("n > 0")
    return found.groupBy("trap").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), F.sum("ms").alias("ms")).join(_examples(found, ["trap"], "n"), "trap")


def repeat_report(facts: DataFrame, most: int = 5) -> DataFrame:
    """One row: retries, retry_sessions, loops, loop_calls, loop_sessions, and distinct examples, looping ones first."""
    done = facts.filter("analyzed")
    sums = done.agg(F.sum("retries").alias("retries"), F.count_if(F.col("retries") > 0).alias("retry_sessions"), F.sum("loops").alias("loops"), F.sum("loop_calls").alias("loop_calls"), F.count_if(F.col("loops") > 0).alias("loop_sessions"))
    looped = done.filter("loops > 0").orderBy(F.desc("loop_calls"), "ord").limit(most).select(F.lit(0).alias("k"), F.col("loop_calls").alias("amount"), "ord", "path")
    retried = done.filter("retries > 0").orderBy(F.desc("retries"), "ord").limit(most).select(F.lit(1).alias("k"), F.col("retries").alias("amount"), "ord", "path")
    both = looped.unionByName(retried).groupBy("path").agg(F.min(F.struct("k", -F.col("amount"), "ord")).alias("place"))  # at most 2 * most rows
    return sums.crossJoin(F.broadcast(both.agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]), 1, most).alias("examples"))))


def stall_report(facts: DataFrame) -> DataFrame:
    """One row: stalls, sessions, ms and the sessions with the longest ones."""
    done = facts.filter("analyzed and stalls > 0").withColumn("all", F.lit(1))
    return done.groupBy("all").agg(F.sum("stalls").alias("stalls"), F.count("*").alias("sessions"), F.sum("stall_ms").alias("ms")).join(_examples(done, ["all"], "longest_stall_ms"), "all").drop("all")


def most_expensive(facts: DataFrame, most: int = 10) -> DataFrame:
    return facts.filter("analyzed and cost > 0").orderBy(F.desc("cost"), "ord").limit(most)


def active_ms(first_ms: Column, last_ms: Column, timed: Column, start_ms: Column, end_ms: Column, idle_ms: Column) -> Column:
    """Time that recorded events show: their span, no longer than the session's, less idle gaps.

    A session without bounds has those of its events; one with fewer than two timed events shows no time.
    """
    start, end = F.coalesce(start_ms, first_ms), F.coalesce(end_ms, last_ms)
    duration = F.when(end > start, end - start).otherwise(0)
    span = F.when((timed >= 2) & (last_ms > first_ms), last_ms - first_ms).otherwise(0)
    return F.greatest(F.lit(0), F.least(span, duration) - F.coalesce(idle_ms, F.lit(0)))


def steps(events: DataFrame) -> DataFrame:
    """Calls and results of sessions in one table: ``events`` (path, seq, ms, type, tool_use_id, tool, input, text, is_error)
    with the call that a result answers (of_tool, of_input) and gap, the milliseconds since the latest time seen.

    ``type`` is call, tool_result, assistant or user. The answered call is the latest earlier one with the id.
    """
    before = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    of_id = Window.partitionBy("path", "tool_use_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    call = F.when((F.col("type") == "call") & F.col("tool_use_id").isNotNull(), F.struct("tool", "input"))
    answered = F.when((F.col("type") == "tool_result") & F.col("tool_use_id").isNotNull(), F.last(call, ignorenulls=True).over(of_id))
    timed = events.withColumns({"gap": F.col("ms") - F.max("ms").over(before), "last_type": F.last("type").over(before)})
    return timed.withColumn("of", answered).withColumns({"of_tool": F.col("of.tool"), "of_input": F.col("of.input")}).drop("of")


def waits(rows: DataFrame) -> DataFrame:
    """(path, stalls, stall_ms, idle_ms, longest_ms, longest_after) of the gaps of STALL or more in ``steps``.

    The agent waits where a long-running tool answers, or where the model answers a result; other gaps are idle.
    """
    tool = F.coalesce((F.col("type") == "tool_result") & E.is_long_running(F.col("of_tool")) & F.col("of_tool").isNotNull() & (F.col("gap") <= TOOL_WAIT_MOST), F.lit(False))
    model = F.coalesce((F.col("type") == "assistant") & (F.col("last_type") == "tool_result") & (F.col("gap") <= MODEL_WAIT), F.lit(False))
    after = F.when(tool, F.substring(F.concat(F.col("of_tool"), F.lit(": "), F.coalesce("of_input", F.lit(""))), 1, 100)).otherwise("a model turn")
    long = rows.filter(F.col("gap") >= STALL).withColumns({"waited": tool | model, "after": after})
    longest = F.max_by(F.struct("gap", "after"), F.when(F.col("waited"), F.struct("gap", -F.col("seq"))))
    return long.groupBy("path").agg(F.count_if("waited").alias("stalls"), F.sum(F.when(F.col("waited"), F.col("gap")).otherwise(0)).alias("stall_ms"), F.sum(F.when(F.col("waited"), 0).otherwise(F.col("gap"))).alias("idle_ms"), longest.alias("longest")).select("path", "stalls", "stall_ms", "idle_ms", F.when(F.col("stalls") > 0, F.col("longest.gap")).alias("longest_ms"), F.when(F.col("stalls") > 0, F.col("longest.after")).alias("longest_after"))


def traps(rows: DataFrame, cwd: Column) -> DataFrame:
    """(path, trap, n, ms, writes, sleep_sec, example) of recurring traps in ``steps``; the example is the first.

    wrong-folder: a failed shell result says the place is wrong. path-bleed: a file or folder of another checkout.
    ci-wait: a command that watches CI, with the waiting it caused. test-hang: a test run that timed out or kept the
    agent waiting for TEST_HANG or more.
    """
    tool, of = F.coalesce("tool", F.lit("")), F.coalesce("of_tool", F.lit(""))
    given, of_given = F.coalesce("input", F.lit("")), F.coalesce("of_input", F.lit(""))
    call, result = F.col("type") == "call", F.col("type") == "tool_result"
    shell, of_shell = tool.rlike(E.SHELL_TOOL), of.rlike(E.SHELL_TOOL)
    stalled = F.when(result & F.col("of_tool").isNotNull() & E.is_long_running(of) & F.col("gap").between(STALL, TOOL_WAIT_MOST), F.col("gap")).otherwise(0)
    failed = result & F.coalesce("is_error", F.lit(False)) & ~E.is_suspect(F.col("text"))
    text = F.coalesce("text", F.lit(""))
    dirs = F.when(call & shell, F.size(F.filter(target_dirs(given), lambda x: path_bleed(cwd, x)))).otherwise(0)
    file_bleed = call & ~shell & tool.rlike(E.FILE_TOOL) & given.startswith("/") & path_bleed(cwd, given)
    entry = lambda name, n, ms, writes, sleep, example: F.struct(F.lit(name).alias("trap"), n.cast("long").alias("n"), ms.cast("long").alias("ms"), writes.cast("long").alias("writes"), sleep.cast("double").alias("sleep_sec"), example.alias("example"))
    one, none = (lambda c: F.when(c, 1).otherwise(0)), F.lit(0)
    ci, tests = call & shell & E.any_match(given, E.CI_WAIT), result & of_shell & E.any_match(of_given, E.TEST_RUNNER)
    hung = tests & ((stalled >= TEST_HANG) | (failed & (E.error_class(text) == "timeout")))
    ci_result = result & of_shell & E.any_match(of_given, E.CI_WAIT)
    found = F.array(
        entry("wrong-folder", one(failed & (of_shell | F.col("of_tool").isNull()) & E.in_wrong_folder(text)), none, none, none, text),
        entry("path-bleed", one(file_bleed) + dirs, none, one(file_bleed & tool.rlike(E.WRITE_TOOL)), none, F.when(file_bleed, F.concat_ws(" ", tool, given)).otherwise(given)),
        entry("test-hang", one(hung), F.when(hung, stalled).otherwise(0), none, none, of_given),
        entry("ci-wait", one(ci), F.when(ci_result, stalled).otherwise(0), none, F.when(ci, E.sleep_seconds(given)).otherwise(0.0), given),
    )
    seen = rows.select("path", "seq", F.explode(found).alias("t")).select("path", "seq", "t.*").filter("n > 0 or ms > 0")
    return seen.groupBy("path", "trap").agg(*(F.sum(c).alias(c) for c in ("n", "ms", "writes", "sleep_sec")), F.min_by("example", F.when(F.col("n") > 0, F.col("seq"))).alias("example"))


def areas(rows: DataFrame, cwd: Column) -> DataFrame:
    """(path, area, hits): the repo area that file tools touch most; the one met first wins ties."""
    hit = rows.filter((F.col("type") == "call") & F.col("tool").rlike(E.FILE_TOOL) & F.col("input").startswith("/")).select("path", "seq", repo_area(cwd, F.col("input")).alias("area")).filter("area is not null")
    counted = hit.groupBy("path", "area").agg(F.count("*").alias("hits"), F.min("seq").alias("first"))
    return top(counted, ["path"], [F.desc("hits"), F.asc("first")], 1).select("path", "area", "hits")


def current_activity(rows: DataFrame) -> DataFrame:
    """(path, line): after the last prompt, the newest call without a result, else the newest assistant text."""
    prompts = Window.partitionBy("path").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    now = rows.withColumn("later", F.coalesce(F.max(F.col("type") == "user").over(prompts), F.lit(False))).filter("not later")
    answered = Window.partitionBy("path", "tool_use_id")
    open_ = now.withColumn("answered", F.max(F.col("type") == "tool_result").over(answered)).filter("type = 'call' and not answered").select("path", "seq", F.concat_ws(" ", "tool", "input").alias("line"), F.lit(1).alias("open"))
    said = now.filter("type = 'assistant' and text <> ''").select("path", "seq", F.col("text").alias("line"), F.lit(0).alias("open"))
    return open_.unionByName(said).groupBy("path").agg(F.max_by("line", F.struct("open", "seq")).alias("line"))
