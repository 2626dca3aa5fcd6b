"""The index row of each recording, from its raw lines: prompts, model, tools, files, commits, errors, tokens, worked time.

A line is parsed once, into a few facts. Facts add up (sums, the first and last by place, distinct files and tools, the
largest usage of a request), so splits of a large recording are summed where they are read and meet in line order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.money import half_up
from weft.functions.records import prompt, tool_name
from weft.operators import timing
from weft.operators.tables import kept, rounds
from weft.sources.recordings import ERROR_TEXT, codex_failed, indexed
from weft.streaming.spans import records, settled_kinds

BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"
TOKENS = "struct<whole:long,output:long,cache_read:long,cache_write:long>"
CALLS = "array<struct<name:string,file:string,command:string,chars:long>>"
# A shell command that commits; tools of one source whose path names a file.
COMMIT = r"(?i)\bgit\b.*\bcommit\b"
PATH_TOOLS = ("Read", "Write", "StrReplace", "Delete")


def _tokens(whole: Column, output: Column, cache_read: Column | None = None, cache_write: Column | None = None) -> Column:
    """``whole`` is all input, what the cache read and wrote included."""
    zero = lambda c: F.coalesce(c if c is not None else F.lit(0), F.lit(0)).cast("long")
    return F.struct(zero(whole).alias("whole"), zero(output).alias("output"), zero(cache_read).alias("cache_read"), zero(cache_write).alias("cache_write"))


def _call(name: Column, input_: Column, fields: tuple[str, ...], tools: tuple[str, ...] = ()) -> Column:
    """A call's common name, the file that one of ``fields`` names (of ``tools`` alone, if given) and its command."""
    at = F.coalesce(*(F.get_json_object(input_, f"$.{f}") for f in fields))
    at = F.when(name.isin(*tools), at) if tools else at
    return F.struct(tool_name(name).alias("name"), at.alias("file"), F.get_json_object(input_, "$.command").alias("command"), (F.length(F.coalesce(name, F.lit(""))) + 20).cast("long").alias("chars"))


def _sum(a: Column, f) -> Column:
    return F.aggregate(F.coalesce(a, F.array().cast("array<long>")), F.lit(0).cast("long"), f)


def facts(lines: DataFrame, source: str) -> DataFrame:
    """path, seq and the facts of each line of (path, seq, line): prompt, model, calls, errors, request, tokens, latest (a
    cumulative count), in_chars, out_chars, worked_ms (where lines say it), and ms, kind, calls and answers of ``records``."""
    rows = lines.filter(indexed(source, F.col("line")) | F.col("line").contains('"turn_ended"'))
    none = {"prompt": F.lit(None).cast("string"), "model": F.lit(None).cast("string"), "used": F.array().cast(CALLS), "errors": F.lit(0), "request": F.lit(None).cast("string"), "tokens": F.lit(None).cast(TOKENS), "latest": F.lit(None).cast(TOKENS), "in_chars": F.lit(0), "out_chars": F.lit(0), "worked_ms": F.lit(None).cast("long")}
    if source in ("claude", "factory", "cursor"):
        usage = "struct<input_tokens:long,output_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long>"
        rows = rows.withColumn("j", F.from_json("line", f"type string, role string, status string, isMeta boolean, requestId string, message struct<id:string,role:string,model:string,content:string,usage:{usage}>"))
        m = F.col("j.message")
        listed = F.ltrim(m["content"]).startswith("[")
        rows = rows.withColumn("b", F.coalesce(F.when(listed, F.from_json(m["content"], BLOCKS)), F.array().cast(BLOCKS)))
        role = {"claude": F.col("j.type"), "factory": F.when(F.col("j.type") == "message", m["role"]), "cursor": F.col("j.role")}[source]
        texts = F.transform(F.filter("b", lambda x: (x["type"] == "text") & x["text"].isNotNull()), lambda x: x["text"])
        said = F.when(listed, F.array_join(texts, "\n")).otherwise(m["content"])
        asked = F.when((role == "user") & ~F.coalesce("j.isMeta", F.lit(False)), prompt(said))
        uses = F.filter("b", lambda x: (x["type"] == "tool_use") & x["name"].isNotNull())
        if source == "cursor":
            calls = F.transform(uses, lambda x: _call(x["name"], x["input"], ("path",), PATH_TOOLS))
        else:
            calls = F.transform(uses, lambda x: _call(x["name"], x["input"], ("file_path",)))
        failed = F.exists("b", lambda x: (x["type"] == "tool_result") & (F.coalesce(x["is_error"], F.lit(False)) | F.coalesce(x["content"].rlike(ERROR_TEXT), F.lit(False))))
        u = m["usage"]
        read, written = (F.coalesce(u[c], F.lit(0)) for c in ("cache_read_input_tokens", "cache_creation_input_tokens"))
        counted = _tokens(F.coalesce(u["input_tokens"], F.lit(0)) + read + written, u["output_tokens"], read, written)
        assistant = role == "assistant"
        named = F.when(m["id"].isNotNull() & (source == "claude"), F.concat_ws("\n", F.coalesce("j.requestId", F.lit("")), m["id"]))
        own = {
            "prompt": asked, "model": F.when(assistant, m["model"]), "used": F.when(assistant, calls), "errors": ((role == "user") & failed | (F.col("j.type") == "turn_ended") & (F.col("j.status") == "error")).cast("int"),
            "request": named, "tokens": F.when(assistant & u.isNotNull(), counted), "in_chars": F.length(asked), "out_chars": F.when(assistant, _sum(F.transform(texts, lambda t: F.length(t).cast("long")), lambda a, x: a + x) + _sum(F.transform(calls, lambda c: c["chars"]), lambda a, x: a + x)),
        }
    elif source == "codex":
        total = "struct<input_tokens:long,output_tokens:long,cached_input_tokens:long>"
        rows = rows.withColumn("j", F.from_json("line", f"type string, payload struct<type:string,role:string,model:string,content:array<struct<type:string,text:string>>,name:string,arguments:string,input:string,output:string,info:struct<total_token_usage:{total},last_token_usage:{total}>>"))
        p = F.col("j.payload")
        item, kind = F.col("j.type") == "response_item", p["type"]
        said = F.array_join(F.transform(p["content"], lambda c: c["text"]), "\n")
        given = F.coalesce(p["arguments"], p["input"])
        call = F.array(_call(p["name"], given, ("file_path", "path")))
        t = F.coalesce(p["info"]["total_token_usage"], p["info"]["last_token_usage"])
        latest = _tokens(t["input_tokens"], t["output_tokens"], t["cached_input_tokens"])
        own = {
            "prompt": F.when(item & (kind == "message") & (p["role"] == "user"), prompt(said)), "model": F.when(F.col("j.type") == "turn_context", p["model"]), "used": F.when(item & kind.isin("function_call", "custom_tool_call"), call),
            "errors": (item & kind.isin("function_call_output", "custom_tool_call_output") & codex_failed(p["output"])).cast("int"), "latest": F.when((F.col("j.type") == "event_msg") & (kind == "token_count") & t.isNotNull(), latest),
        }
    elif source == "dsh":
        rows = rows.withColumn("j", F.from_json("line", "type string, data struct<content:string,source:struct<kind:string>,reason:struct<kind:string>,usage:struct<inputTokens:long,outputTokens:long,cacheReadTokens:long>,message:struct<content:string,isError:boolean,source:struct<model:string>>>"))
        kind, d = F.col("j.type"), F.col("j.data")
        text = lambda c: F.array_join(F.transform(F.filter(F.from_json(c, BLOCKS), lambda x: x["type"] == "text"), lambda x: x["text"]), "\n")
        parts = F.filter(F.from_json(d["message"]["content"], "array<struct<type:string,name:string,arguments:string>>"), lambda x: x["type"] == "tool-call")
        failed = F.coalesce(d["message"]["isError"], F.lit(False)) | F.coalesce(text(d["message"]["content"]).rlike(r"(?m)^\[?exit code:? [1-9]"), F.lit(False))
        u = d["usage"]
        own = {
            "prompt": F.when((kind == "user/message") & (d["source"]["kind"] == "user"), F.nullif(F.trim(text(d["content"])), F.lit(""))), "model": F.when(kind == "assistant/message", d["message"]["source"]["model"]),
            "used": F.when(kind == "assistant/message", F.transform(parts, lambda x: _call(x["name"], x["arguments"], ("file_path", "path")))), "errors": ((kind == "tool/result") & failed | (kind == "turn/end") & (d["reason"]["kind"] == "error")).cast("int"),
            "tokens": F.when((kind == "assistant/message") & u.isNotNull(), _tokens(u["inputTokens"], u["outputTokens"], u["cacheReadTokens"])),
        }
    elif source == "fx":
        rows = rows.withColumn("j", F.from_json("line", "event struct<user:struct<text:string>,tool_call:struct<tool_name:string,arguments_json:string>,tool_result:struct<status:string,preview:string>,turn_completed:struct<turn_summary:struct<turn_duration_ms:long,token_progress:struct<input_tokens:long,output_tokens:long>>>>"))
        e = F.col("j.event")
        s = e["turn_completed"]["turn_summary"]
        code = F.from_json(F.when(e["tool_result"]["preview"].startswith("{"), e["tool_result"]["preview"]), "exit_code int")["exit_code"]
        own = {
            "prompt": F.nullif(F.trim(e["user"]["text"]), F.lit("")), "used": F.when(e["tool_call"].isNotNull(), F.array(_call(e["tool_call"]["tool_name"], e["tool_call"]["arguments_json"], ("file_path", "path")))),
            "errors": (F.coalesce(e["tool_result"]["status"] != "success", F.lit(False)) | F.coalesce(code != 0, F.lit(False))).cast("int"), "worked_ms": s["turn_duration_ms"],
            "tokens": F.when(s["token_progress"].isNotNull(), _tokens(s["token_progress"]["input_tokens"], s["token_progress"]["output_tokens"])),
        }
    else:
        raise ValueError(f"no index of source: {source}")
    filled = {k: F.coalesce(own[k].cast(rows.select(d).schema[0].dataType), d) if k in own else d for k, d in none.items()}
    done = rows.withColumns(filled)
    if source in ("claude", "factory", "codex", "dsh"):
        done = records(done, source)
    else:
        done = done.withColumns({"ms": F.lit(None).cast("long"), "kind": F.lit(timing.OTHER), "calls": F.lit(None).cast("array<struct<id:string,waits:boolean>>"), "answers": F.lit(None).cast("array<string>")})
    return done.select("path", "seq", *none, "ms", "kind", "calls", "answers")


def recorded_index(lines: DataFrame, source: str, default_model: str | None = None) -> DataFrame:
    """One row for each recording of (path, seq, line): first_prompt, model, tools (by first use), tool_counts, chapters
    (prompts), input, output, cache_read and total tokens, estimated, errors, files, commits and worked_ms.

    Tokens follow each source: a request's rows repeat a cumulative usage, of which the largest counts; or lines carry a
    running total, of which the last counts; or turns add up. A source that writes none, or a session without any, has a
    quarter of its characters instead (``estimated``). Lines that aren't JSON count for nothing.
    """
    with rounds(lines.sparkSession) as folder:
        f = kept(facts(lines, source), folder)
        first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
        names = ("whole", "output", "cache_read", "cache_write")
        plain = F.when(F.col("request").isNull(), F.col("tokens"))
        sums = f.groupBy("path").agg(
            first("prompt").alias("first_prompt"), first("model").alias("model"), F.count("prompt").alias("chapters"), F.sum("errors").alias("errors"), F.sum("in_chars").alias("in_chars"), F.sum("out_chars").alias("out_chars"), F.sum("worked_ms").alias("said_ms"),
            F.max_by("latest", F.when(F.col("latest").isNotNull(), F.col("seq"))).alias("latest"), *(F.sum(plain[c]).alias(f"plain_{c}") for c in names),
        )
        once = f.filter("request is not null and tokens is not null").groupBy("path", "request").agg(*(F.max(F.col("tokens")[c]).alias(c) for c in names))
        once = once.groupBy("path").agg(*(F.sum(c).alias(f"once_{c}") for c in names))
        used = f.select("path", "seq", F.posexplode("used").alias("at", "c")).select("path", "seq", "at", "c.*")
        by_tool = used.groupBy("path", "name").agg(F.count("*").alias("n"), F.min(F.struct("seq", "at")).alias("first"), F.count_if(F.coalesce(F.col("command").rlike(COMMIT), F.lit(False))).alias("commits"))
        tools = by_tool.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda x: x["name"]).alias("tools"), F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("tool_counts"), F.sum("commits").alias("commits"))
        files = used.filter("file <> ''").groupBy("path", "file").count().groupBy("path").agg(F.count("*").alias("files"))
        worked = timing.worked_time(settled_kinds(f.select("path", "seq", "ms", "kind", "calls", "answers")))
        # durations end at the last message for one source
        ended = F.coalesce("at_message_ms", "active_ms") if source == "claude" else F.col("active_ms")
        whole = sums.join(once, "path", "left").join(tools, "path", "left").join(files, "path", "left").join(worked, "path", "left")
        got = {c: F.coalesce(F.col("latest")[c], F.coalesce(f"plain_{c}", F.lit(0)) + F.coalesce(f"once_{c}", F.lit(0))) for c in names}
        # two sources show what was neither read from the cache nor, for one of them, written to it
        got["input"] = got["whole"] - (got["cache_read"] if source in ("claude", "factory") else 0) - (got["cache_write"] if source == "claude" else 0)
        got["total"] = got["whole"] + got["output"]
        none = (got["input"] == 0) & (got["output"] == 0) if source in ("factory", "cursor") else F.lit(False)
        guess_in, guess_out = half_up(F.col("in_chars") / 4).cast("long"), half_up(F.col("out_chars") / 4).cast("long")
        guessed = {"input": guess_in, "output": guess_out, "cache_read": F.lit(0).cast("long"), "total": guess_in + guess_out}
        return kept(whole.select(
            "path", "first_prompt", F.coalesce("model", F.lit(default_model)).alias("model"), F.coalesce("tools", F.array().cast("array<string>")).alias("tools"), F.coalesce("tool_counts", F.create_map().cast("map<string,long>")).alias("tool_counts"), "chapters",
            *(F.when(none, guessed[c]).otherwise(got[c]).alias(c) for c in ("input", "output", "cache_read", "total")), none.alias("estimated"), "errors", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("commits", F.lit(0)).alias("commits"), F.coalesce("said_ms", ended, F.lit(0)).alias("worked_ms"),
        ))
