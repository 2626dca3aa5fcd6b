"""Chat formatting by quotation linking.

Messages quote others with ``>`` at the start of a line, one more for each level. Quoted lines of one level that follow
each other are a passage; passages are normalised (lower case, single blanks, so wrapping doesn't matter) and hashed, and
joined to the messages of the same conversation that wrote them, any run of words of theirs: the first ANCHOR words find
places, and at each place the hash of as many words as the passage has decides. Shorter passages must be whole lines.
Among messages only the first that wrote a passage counts; joins are on hashes that someone quotes, and what they return
follows from the places of these, not from how often a passage is quoted. A message replies to the original that its
quotes of the shallowest linked level name most (by characters; ties: the latest). Replies form trees; a message's root
is found by doubling, and conversations are read root by root, in order of turns, without the quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import computed_once, stash, table

ANCHOR = 5
QUOTE = r"^[ \t]{0,3}>"
MARKS = r"^((?:[ \t]{0,3}>)+)"


def words_of(text: Column) -> Column:
    """The lower-case words of a text, as an array."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def hash_of(words: Column) -> Column:
    return F.xxhash64(F.array_join(words, " "))


def passages(turns: DataFrame) -> DataFrame:
    """conv_id, turn, level and words of the runs of quoted lines of one level in (conv_id, turn, text), in order; blank
    quoted lines go on with a passage.

    A line's words are taken once, and so are those of a run: the places where the level changes cut the list of lines.
    """
    quoted = F.filter(F.split("text", r"\r?\n"), lambda x: x.rlike(QUOTE))
    one = F.transform(quoted, lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")).alias("level"), words_of(F.regexp_replace(x, MARKS, "")).alias("words")))
    lines = computed_once(turns.filter(F.col("text").contains(">")), "one", one).filter(F.size("one") > 0)
    changes = F.filter(F.sequence(F.lit(0), F.size("one") - 1), lambda i: (i == 0) | (F.get("one", i)["level"] != F.get("one", i - 1)["level"]))
    cut = computed_once(lines, "starts", changes)
    stop = lambda j: F.coalesce(F.get("starts", j + 1), F.size("one"))
    run = lambda s, j: F.struct(F.get("one", s)["level"].alias("level"), F.flatten(F.transform(F.slice("one", s + 1, stop(j) - s), lambda x: x["words"])).alias("words"))
    runs = cut.select("conv_id", "turn", F.explode(F.transform("starts", run)).alias("p")).select("conv_id", "turn", "p.level", "p.words")
    return runs.filter(F.size("words") > 0)


def reply_order(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quoted, reply_to, root_turn and depth of every row of ``turns``.

    A message without a linked quote has no reply_to: it is its own root at depth 0. A null text has no lines and
    stays null; an empty one stays empty. Quotes of the message itself or of later ones don't link. Null conv_ids or
    turns never link. Rows that repeat a (conv_id, turn) reply alike and can be replied to as one. An empty table
    gives an empty result; extra columns are dropped. Sorting the result by conv_id, root_turn and turn reads
    conversations in reply order: a reply always comes after what it replies to.
    """
    lines = F.split(F.col("text"), r"\r?\n")
    cut = turns.select("conv_id", "turn", "role", F.array_join(F.filter(lines, lambda x: ~x.rlike(QUOTE)), "\n").alias("text"), F.size(F.filter(lines, lambda x: x.rlike(QUOTE))).alias("n_quoted"))
    quoted = passages(turns.select("conv_id", "turn", "text"))
    n = F.size("words")
    anchor = F.when(n >= ANCHOR, hash_of(F.slice("words", 1, ANCHOR))).otherwise(hash_of(F.col("words")))
    quoted = quoted.select("conv_id", "turn", "level", n.alias("n"), anchor.alias("anchor"), hash_of(F.col("words")).alias("h"), F.length(F.array_join("words", " ")).alias("size"))
    quoted = stash(quoted.groupBy("conv_id", "turn", "level", "n", "anchor", "h").agg(F.sum("size").alias("size")))
    wanted = quoted.select("conv_id", "n", "anchor", "h").distinct()
    # places: every run of ANCHOR words of a message, and its short lines as they are, in conversations that quote anything
    own = cut.join(wanted.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", words_of(F.col("text")).alias("words"), F.filter(F.transform(F.split("text", "\n"), words_of), lambda w: F.size(w).between(1, ANCHOR - 1)).alias("short"))
    runs = F.transform(F.when(F.size("words") >= ANCHOR, F.sequence(F.lit(1), F.size("words") - ANCHOR + 1)), lambda i: F.struct(i.alias("at"), hash_of(F.slice("words", i, ANCHOR)).alias("anchor")))
    short = F.transform("short", lambda w: F.struct(F.lit(0).alias("at"), hash_of(w).alias("anchor")))
    places = own.select("conv_id", "turn", F.explode(F.concat(F.coalesce(runs, F.slice(short, 1, 0)), F.coalesce(short, F.array().cast("array<struct<at:int,anchor:bigint>>")))).alias("x")).select("conv_id", "turn", "x.at", "x.anchor")
    found = places.join(wanted, ["conv_id", "anchor"]).filter((F.col("at") > 0) == (F.col("n") >= ANCHOR))
    lines_found = found.filter("at = 0").select("conv_id", "turn", "h")
    runs_found = found.filter("at > 0").join(own.select("conv_id", "turn", "words"), ["conv_id", "turn"]).filter(hash_of(F.slice("words", F.col("at"), F.col("n"))) == F.col("h")).select("conv_id", "turn", "h")
    origin = lines_found.unionByName(runs_found).groupBy("conv_id", "h").agg(F.min("turn").alias("origin"))
    linked = quoted.join(origin, ["conv_id", "h"]).filter("origin < turn").groupBy("conv_id", "turn", "level", "origin").agg(F.sum("size").alias("size"))
    parent = stash(linked.groupBy("conv_id", "turn").agg(F.max_by("origin", F.struct(-F.col("level"), "size", "origin")).alias("reply_to")))
    # (ancestor, steps) of replies, doubled until every ancestor is a root
    up = parent.select("conv_id", "turn", F.col("reply_to").alias("ancestor"), F.lit(1).alias("steps"))
    while True:
        above = up.select("conv_id", F.col("turn").alias("ancestor"), F.col("ancestor").alias("further"), F.col("steps").alias("more"))
        joined = stash(up.join(above, ["conv_id", "ancestor"], "left").select("conv_id", "turn", F.coalesce("further", "ancestor").alias("ancestor"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("further").isNotNull().alias("moved")))
        up = joined.drop("moved")
        if joined.filter("moved").isEmpty():
            break
    tree = parent.join(up, ["conv_id", "turn"])
    out = cut.join(tree, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "text", F.greatest("n_quoted", F.lit(0)).alias("n_quoted"), "reply_to", F.coalesce("ancestor", "turn").alias("root_turn"), F.coalesce("steps", F.lit(0)).alias("depth"))


def op7_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(table(spark, sf_dir, "conversations"))
