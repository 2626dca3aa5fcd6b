"""Chapters: what follows one prompt until the next, their outcomes, links and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.tables import kept, rounds


def with_chapters(events: DataFrame, key: str = "path", order: str = "seq", prompt: Column | None = None) -> DataFrame:
    """``events`` with chapter: 0 before the first prompt, then counted up at each."""
    prompt = F.col("role") == "user" if prompt is None else prompt
    return events.withColumn("chapter", F.sum(F.coalesce(prompt, F.lit(False)).cast("int")).over(Window.partitionBy(key).orderBy(order)))


def outcome(errors: Column, retries: Column, fixes: Column, corrected: Column, turns: Column) -> Column:
    """clean, corrected or struggling, by the first rule that holds."""
    return (
        F.when((errors == 0) & (retries == 0), "clean")
        .when((fixes > 0) & (fixes >= errors * 0.5), "corrected")
        .when(corrected, "corrected")
        .when((retries >= 3) | (errors >= 3), "struggling")
        .when(fixes > 0, "corrected")
        .when((errors >= 2) & (fixes == 0), "struggling")
        .when((errors == 1) & (turns > 1), "corrected")
        .when((retries > 0) | (errors > 0), "corrected")
        .otherwise("clean")
    )


def shared_files(chapters: DataFrame, key: str = "path", back: int = 10) -> DataFrame:
    """(key, idx, prev_idx, shared, continues, fixes) of chapters (idx, files, errors, outcome) and earlier ones nearby.

    Chapters meet by file and tenth (``back``) of chapters, their own and the one before, so however often a session
    touches a file, a chapter only meets those nearby.
    """
    tenth = F.expr(f"idx div {back}")
    touched = chapters.select(key, "idx", tenth.alias("tenth"), F.size("files").alias("n_files"), F.explode(F.array_distinct("files")).alias("file"))
    earlier = chapters.select(key, F.col("idx").alias("prev_idx"), F.explode(F.array(tenth, tenth + 1)).alias("tenth"), ((F.col("outcome") == "struggling") | (F.col("errors") >= 2)).alias("bad"), "files")
    earlier = earlier.select(key, "prev_idx", "tenth", "bad", F.explode(F.array_distinct("files")).alias("file"))
    pairs = touched.join(earlier, [key, "file", "tenth"]).filter((F.col("prev_idx") < F.col("idx")) & (F.col("prev_idx") >= F.col("idx") - back))
    links = pairs.groupBy(key, "idx", "prev_idx").agg(F.count("*").alias("shared"), F.first("n_files").alias("n_files"), F.first("bad").alias("fixes"))
    near = (F.col("shared") >= F.least(F.lit(2), F.col("n_files"))) | (F.col("shared") >= F.col("n_files") * 0.5)
    return links.withColumn("continues", near & ~F.col("fixes")).drop("n_files")


def chains(links: DataFrame, key: str = "path") -> DataFrame:
    """(key, idx, chain): chapters join the chain of what they continue, else of what they fix, else found one.

    In order, a chapter joins the first of its earlier chapters that has a chain by then; if none has, the first of them
    founds one. An earlier chapter with links of its own has a chain for certain; one without has it if some chapter
    before founded it. So only chapters all of whose earlier ones have no links decide anything: such a chapter founds
    unless one before it founded one of its earlier ones. They are decided in rounds, all at once whose rivals before
    them are decided; then every chapter points to what it joins, and pointers are doubled up to the founders. Chains
    are numbered by when they were founded.
    """
    wanted = links.filter("continues or fixes").select(key, "idx", "prev_idx", F.explode(F.array_compact(F.array(F.when(F.col("continues"), 0), F.when(F.col("fixes"), 1)))).alias("kind"))
    order = Window.partitionBy(key, "idx").orderBy("kind", "prev_idx")
    with rounds(links.sparkSession) as folder:
        wanted = kept(wanted.withColumn("pos", F.row_number().over(order)).drop("kind"), folder)
        linked = kept(wanted.select(key, "idx").distinct(), folder)
        known = linked.select(key, F.col("idx").alias("prev_idx"), F.lit(True).alias("linked"))
        wanted = kept(wanted.join(known, [key, "prev_idx"], "left"), folder)
        deciding = wanted.groupBy(key, "idx").agg(F.max("linked").alias("any"), F.min_by("prev_idx", "pos").alias("first")).filter("any is null").drop("any")
        open_ = kept(deciding, folder)
        one = open_.select(key, F.col("idx").alias("rival"), F.col("first").alias("prev_idx"))
        edges = kept(wanted.select(key, "idx", "prev_idx").join(open_.select(key, "idx"), [key, "idx"], "left_semi").join(one, [key, "prev_idx"]).filter("rival < idx").select(key, "idx", "rival").distinct(), folder)
        founding = []
        while True:
            free = kept(open_.join(edges.select(key, "idx").distinct(), [key, "idx"], "left_anti"), folder)
            founding.append(free)
            held = edges.join(free.select(key, F.col("idx").alias("rival")), [key, "rival"], "left_semi").select(key, "idx").distinct()
            rest = kept(open_.join(free, [key, "idx"], "left_anti").join(held, [key, "idx"], "left_anti"), folder)
            if rest.isEmpty():
                break
            edges = kept(edges.join(rest.select(key, "idx"), [key, "idx"], "left_semi").join(rest.select(key, F.col("idx").alias("rival")), [key, "rival"], "left_semi"), folder)
            open_ = rest
        founded = reduce(DataFrame.unionByName, founding)
        founded = kept(founded.select(key, F.col("first").alias("founder"), F.col("idx").alias("since"), (F.row_number().over(Window.partitionBy(key).orderBy("idx")) - 1).cast("long").alias("chain")), folder)
        since = founded.select(key, F.col("founder").alias("prev_idx"), "since")
        joins = wanted.join(since, [key, "prev_idx"], "left").filter("linked or since <= idx")
        up = kept(joins.groupBy(key, "idx").agg(F.min_by("prev_idx", "pos").alias("to")), folder)
        while True:
            further = up.select(key, F.col("idx").alias("to"), F.col("to").alias("further"))
            moved = kept(up.join(further, [key, "to"], "left").select(key, "idx", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), folder)
            up = moved.drop("moved")
            if moved.filter("moved").isEmpty():
                break
        named = founded.select(key, F.col("founder").alias("to"), "chain")
        out = up.join(named, [key, "to"]).select(key, "idx", "chain").unionByName(founded.select(key, F.col("founder").alias("idx"), "chain"))
        return kept(out.select(key, F.col("idx").cast("long").alias("idx"), "chain"))


def similar_target(tool: Column, target: Column) -> Column:
    """What two calls of a tool must share to try the same: the path, a shell command as it is, else the first two words."""
    words = F.split(F.trim(target), r"\s+")
    return F.when(tool.isin("Edit", "Write", "Read"), F.substring_index(target, "/", -2)).when(tool == "Bash", target).otherwise(F.concat_ws(" ", F.slice(words, 1, 2)))


def retry_groups(calls: DataFrame, keys: tuple[str, ...] = ("path", "chapter"), ahead: int = 8) -> DataFrame:
    """(keys, start_ord, attempts, resolved): greedy groups of a failed call and what tries the same again.

    A group ends with its first success, and the scan goes on behind it. ``calls`` has ord without gaps in a chapter,
    tool, target and failed. What a call's group would be shows in the ``ahead - 1`` calls behind it. Such groups may
    overlap, and which of them count depends on those before; but a group that none before reaches counts for certain,
    and from there each group points to the first that begins behind its end. Pointers are followed by doubling, between
    certain groups only.
    """
    keys_ = list(keys)
    known = calls.withColumn("same", F.concat_ws("\n", "tool", similar_target(F.col("tool"), F.col("target"))))
    order = Window.partitionBy(*keys_).orderBy("ord")
    near = F.collect_list(F.struct("ord", "same", "failed")).over(order.rowsBetween(1, ahead - 1))
    tried = known.select(*keys_, "ord", "same", "failed", near.alias("near")).filter("failed").withColumn("tries", F.expr("filter(near, x -> x.same = same)")).filter(F.size("tries") > 0)
    success = F.array_position(F.transform("tries", lambda x: x["failed"]), False)
    attempts = F.when(success > 0, success).otherwise(F.size("tries")).cast("int")
    groups = tried.select(*keys_, "ord", (attempts + 1).cast("long").alias("attempts"), (success > 0).alias("resolved"), F.get("tries", attempts - 1)["ord"].alias("end"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.collect_list("ord").over(order.rowsBetween(1, ahead))
    with rounds(calls.sparkSession) as folder:
        groups = groups.withColumns({"counts": F.coalesce(reach < F.col("ord"), F.lit(True)), "behind": behind})
        groups = kept(groups.withColumn("to", F.get(F.expr("filter(behind, x -> x > end)"), F.lit(0))).drop("behind"), folder)
        certain = groups.filter("counts").select(*keys_, F.col("ord").alias("to"), F.lit(True).alias("sure"))
        state = kept(groups.join(certain, [*keys_, "to"], "left").select(*keys_, "ord", "counts", F.when(F.col("sure").isNull(), F.col("to")).alias("to")), folder)
        while not state.filter("to is not null").isEmpty():
            reached = state.filter("counts and to is not null").select(*keys_, F.col("to").alias("ord"), F.lit(True).alias("reached")).distinct()
            jumps = state.filter("to is not null").select(*keys_, F.col("ord").alias("to"), F.col("to").alias("further"))
            state = kept(state.join(reached, [*keys_, "ord"], "left").join(jumps, [*keys_, "to"], "left").select(*keys_, "ord", (F.col("counts") | F.coalesce("reached", F.lit(False))).alias("counts"), F.col("further").alias("to")), folder)
        taken = groups.drop("counts", "to", "end").join(state.filter("counts").select(*keys_, "ord"), [*keys_, "ord"], "left_semi")
        return kept(taken.select(*keys_, F.col("ord").cast("long").alias("start_ord"), "attempts", "resolved"))


def merged_messages(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, message, role, content): consecutive turns of one role as one message, in order."""
    w = Window.partitionBy(key).orderBy(order)
    flip = F.coalesce(F.col("role") != F.lag("role").over(w), F.lit(True)).cast("int")
    islands = turns.withColumn("flip", flip).withColumn("message", F.sum("flip").over(w))
    parts = F.sort_array(F.collect_list(F.struct(order, "text")))
    return islands.groupBy(key, "message", "role").agg(F.array_join(F.transform(parts, lambda x: F.coalesce(x["text"], F.lit(""))), "\n\n").alias("content"))


def as_json(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, messages): one JSON array of {role, content} for each conversation."""
    parts = F.sort_array(F.collect_list(F.struct("message", "role", "content")))
    return messages.groupBy(key).agg(F.to_json(F.transform(parts, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("messages"))


def as_markdown(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct(order, "role", "text")))
    return turns.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: F.concat(F.lit("## "), x["role"], F.lit("\n\n"), F.coalesce(x["text"], F.lit("")))), "\n\n").alias("markdown"))


def longest_remainder(parts: DataFrame, key: str, weight: str, target: Column, order: str) -> DataFrame:
    """``parts`` with share: ``target`` whole units by weight, the remainders to the largest fractions."""
    w = Window.partitionBy(key)
    exact = target * F.col(weight) / F.sum(weight).over(w)
    floored = parts.withColumns({"exact": exact, "share": F.floor(exact)})
    rest = target - F.sum("share").over(w)
    rank = F.row_number().over(w.orderBy(F.desc(F.col("exact") - F.col("share")), order))
    return floored.withColumn("share", F.col("share") + F.when(rank <= rest, 1).otherwise(0)).drop("exact")


