"""Session recordings of coding agents as one table of events.

Every reader returns path, seq, source, type (user, assistant or tool_result), ts, text, tool_calls, tool_use_id,
is_error, model and usage. ``seq`` orders the events of a path. Lines that aren't JSON are skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weft.functions.records import displayable, prompt, tool_name

CALLS = "array<struct<id:string,name:string,input:string>>"
USAGE = "struct<input:long,output:long,cache_read:long,cache_write:long>"
EVENT = f"path string, seq long, source string, type string, ts timestamp, text string, tool_calls {CALLS}, tool_use_id string, is_error boolean, model string, usage {USAGE}"
# The beginning of a line that tells a failed result, and names of tools of one source.
ERROR_TEXT = r"(?im)^(?:Error:|exit code [1-9]|command failed|ENOENT|EACCES|SyntaxError|TypeError|ReferenceError)"
FX_TOOLS = {"glob_files": "glob", "grep_files": "grep", "subagent": "agent"}
BLOCK = "struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>"

def lines(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, seq, line): splits of a file in order, lines of a split in order; large files are read in parallel.

    ``seq`` is the line's place in its split plus the split's first byte, so it grows along the file. A task reads its
    splits one after the other, so the lines are counted as they pass, in one scan and without an exchange.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, 0
        for batch in batches:
            paths, starts = batch.column("path").to_pylist(), batch.column("start").to_pylist()
            seq = []
            for at in zip(paths, starts, strict=True):
                done = done + 1 if at == last else 0
                last = at
                seq.append(at[1] + done)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(seq, pa.int64()), batch.column("line")], ["path", "seq", "line"])

    raw = spark.read.text(pattern).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
    return raw.mapInArrow(number, "path string, seq long, line string")


def first_lines(paths: DataFrame, most: int = 4 << 20) -> DataFrame:
    """``paths`` (path and others) with line: the first line of each file, read from its beginning and no further than
    ``most`` bytes; of files of zstd frames what they hold. A longer first line is cut, an empty file's is empty."""

    def one(path: str) -> str:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
        with store.open_input_stream(at, compression=None) as raw:
            read = raw.read
            if path.endswith((".zstd", ".zst")):
                import zstandard

                read = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read1  # what is decoded at once
            data = b""
            while b"\n" not in data and len(data) < most:
                try:
                    more = read(65536)
                except Exception as error:  # a damaged frame: what came before it counts
                    if type(error).__name__ != "ZstdError":
                        raise
                    break
                if not more:
                    break
                data += more
        return data.split(b"\n", 1)[0][:most].decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "line"])

    from pyspark.sql.types import StringType, StructField, StructType

    return paths.mapInArrow(run, StructType([*paths.schema.fields, StructField("line", StringType())]))


def indexed(source: str, line: Column) -> Column:
    """Whether a line can matter to a reader, told from its text before any JSON is parsed."""
    starts = lambda *kinds: reduce(lambda a, b: a | b, (line.startswith('{"type":"' + k + '"') | line.startswith('{"type": "' + k + '"') for k in kinds))
    has = lambda *parts: reduce(lambda a, b: a | b, (line.contains(f'"{p}"') for p in parts))
    gates = {
        "claude": ~starts("progress") & ~(starts("system", "queue") & ~has("sessionId", "cwd", "gitBranch")),
        "codex": ~starts("stream_chunk") & has("session_meta", "turn_context", "response_item", "event_msg"),
        "factory": starts("message"),
        "grok": ~starts("system"),
        "dsh": (line.startswith('{"type":"user/message"') & line.contains('"source":{"kind":"user"}')) | starts("session", "assistant/message", "tool/call", "tool/result", "turn/end"),
    }
    return line.startswith("{") & gates[source] if source in gates else line.startswith("{")


def head(rows: DataFrame, most: int = 524_288) -> DataFrame:
    """The whole lines of each file within its first ``most`` bytes, of (path, seq, line): enough for a preview."""
    upto = F.sum(F.octet_length("line") + 1).over(Window.partitionBy("path").orderBy("seq"))
    # a line's place counts at least the lines before it, so what lies far behind is dropped before the sort
    return rows.filter(F.col("seq") < most).withColumn("upto", upto).filter(F.col("upto") <= most).drop("upto")


def tail(rows: DataFrame, most: int = 131_072) -> DataFrame:
    """The lines of each file that begin within its last ``most`` bytes, its last line whatever its size, with mid_write:
    the last line isn't whole JSON, so a record is being appended."""
    back = Window.partitionBy("path").orderBy(F.desc("seq"))
    behind = F.coalesce(F.sum(F.octet_length("line") + 1).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = rows.filter(F.trim("line") != "").withColumns({"behind": behind, "size": F.octet_length("line") + 1}).filter((F.col("behind") + F.col("size") <= most) | (F.col("behind") == 0))
    # null where try_parse_json fails: the writer isn't done
    broken = F.when(F.col("behind") == 0, F.try_parse_json("line").isNull())
    return kept.withColumn("mid_write", F.coalesce(F.max(broken).over(Window.partitionBy("path")), F.lit(False))).drop("behind", "size")


def _shape(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    """Fill what a source doesn't have with nulls and fix names and types."""
    from pyspark.sql.types import StructType

    columns = {"path": F.col("path"), "seq": F.col("seq"), "source": F.lit(source)} | columns
    return df.select(*(columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(EVENT).fields))


def _blocks(content: Column) -> Column:
    """Message content as blocks; a plain string is one text block."""
    parsed = F.from_json(content, f"array<{BLOCK}>")
    plain = F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), content.alias("text"))), BLOCK))
    return F.when(F.ltrim(content).startswith("["), parsed).otherwise(F.when(content.isNotNull(), plain))


def _text(blocks: Column) -> Column:
    return F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")


def _calls(blocks: Column) -> Column:
    return F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: F.struct(b["id"].alias("id"), tool_name(b["name"]).alias("name"), b["input"].alias("input")))


def _messages(parsed: DataFrame, source: str, role: Column, ts: Column, model: Column, usage: Column) -> DataFrame:
    """Rows of role-tagged blocks: assistant turns, prompts, and one tool result for each result block."""
    b = parsed.withColumn("blocks", _blocks(F.col("content"))).filter("blocks is not null").withColumns({"role_": role, "ts_": ts, "model_": model, "usage_": usage})
    assistant = _shape(b.filter("role_ = 'assistant'"), source, seq=F.col("seq") * 1000, type=F.lit("assistant"), ts=F.col("ts_"), text=_text(F.col("blocks")), tool_calls=_calls(F.col("blocks")), model=F.col("model_"), usage=F.col("usage_"))
    said = b.filter("role_ = 'user'").withColumn("said", _text(F.col("blocks"))).filter("said <> ''")
    user = _shape(said, source, seq=F.col("seq") * 1000 + 999, type=F.lit("user"), ts=F.col("ts_"), text=F.col("said"))
    results = b.filter("role_ in ('user', 'tool')").select("*", F.posexplode(F.filter("blocks", lambda x: x["type"] == "tool_result")).alias("pos", "r"))
    result = _shape(results, source, seq=F.col("seq") * 1000 + F.least("pos", F.lit(998)), type=F.lit("tool_result"), ts=F.col("ts_"), text=F.coalesce(_text(_blocks(F.col("r.content"))), F.col("r.content")), tool_use_id=F.col("r.tool_use_id"), is_error=F.coalesce("r.is_error", F.lit(False)))
    return assistant.unionByName(user).unionByName(result)


def claude(rows: DataFrame) -> DataFrame:
    schema = "type string, isMeta boolean, timestamp string, message struct<role:string,model:string,content:string,usage:struct<input_tokens:long,output_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long>>"
    p = rows.withColumn("j", F.from_json("line", schema)).filter("j.type in ('user', 'assistant') and not coalesce(j.isMeta, false)").withColumn("content", F.col("j.message.content"))
    u = F.col("j.message.usage")
    usage = F.struct(u["input_tokens"].alias("input"), u["output_tokens"].alias("output"), u["cache_read_input_tokens"].alias("cache_read"), u["cache_creation_input_tokens"].alias("cache_write"))
    return _messages(p, "claude", F.col("j.type"), F.expr("try_to_timestamp(j.timestamp)"), F.col("j.message.model"), F.when(u.isNotNull(), usage))


def cursor(rows: DataFrame) -> DataFrame:
    p = rows.withColumn("j", F.from_json("line", "role string, message struct<content:string>")).filter("j.role in ('user', 'assistant')").withColumn("content", F.col("j.message.content"))
    return _messages(p, "cursor", F.col("j.role"), F.lit(None).cast("timestamp"), F.lit(None).cast("string"), F.lit(None).cast(USAGE))


def factory(rows: DataFrame) -> DataFrame:
    p = rows.withColumn("j", F.from_json("line", "type string, timestamp string, message struct<role:string,content:string>")).filter("j.type = 'message'").withColumn("content", F.col("j.message.content"))
    return _messages(p, "factory", F.col("j.message.role"), F.expr("try_to_timestamp(j.timestamp)"), F.lit(None).cast("string"), F.lit(None).cast(USAGE))


def codex_failed(output: Column) -> Column:
    """Whether a result says that its call failed: a structured status counts before what the text looks like.

    A printed example of a status, or JSON that isn't a result's envelope, says nothing.
    """
    status = "exit_code int, is_error boolean, isError boolean, success boolean, error string"
    says = lambda o: F.coalesce((o["exit_code"] != 0) | o["is_error"] | o["isError"] | ~o["success"] | ((o["error"] != "") & (o["error"] != "false")), F.coalesce(o["exit_code"] != 0, o["is_error"], o["isError"], ~o["success"], (o["error"] != "") & (o["error"] != "false"), F.lit(False)))
    whole = F.from_json(output, status)
    # fixed values: how a result's text says that its command ended or failed
    exited = F.nullif(F.regexp_extract(output, r"(?i)\A(?:Chunk ID:[^\n]*\n)?(?:Wall time:[^\n]*\n)?Process exited with code (-?\d+)\b", 1), F.lit(""))
    said = output.rlike(r"(?i)\A(?:Script failed\b|apply_patch verification failed:|Failed to (?:find expected lines|apply patch)|(?:command|execution|tool|js execution) timed out\b|Error (?:parsing function call|executing tool)\b)")
    envelopes = F.filter(F.split(output, "\n"), lambda x: F.ltrim(x).startswith('{"chunk_id"'))
    nested = F.exists(envelopes, lambda x: says(F.from_json(x, status)))
    return F.when(exited.isNotNull(), exited != "0").when(said, True).when(F.ltrim(output).startswith("{"), says(whole)).otherwise(F.coalesce(nested, F.lit(False)))


def codex(rows: DataFrame) -> DataFrame:
    schema = "timestamp string, type string, payload struct<type:string,role:string,content:array<struct<type:string,text:string>>,name:string,call_id:string,arguments:string,input:string,output:string>"
    p = rows.withColumn("j", F.from_json("line", schema)).filter("j.type = 'response_item'").withColumns({"p": F.col("j.payload"), "at": F.expr("try_to_timestamp(j.timestamp)")})
    said = F.array_join(F.transform("p.content", lambda c: c["text"]), "\n")
    message = _shape(p.filter("p.type = 'message' and p.role in ('user', 'assistant')"), "codex", type=F.col("p.role"), ts=F.col("at"), text=said)
    call = F.array(F.struct(F.col("p.call_id").alias("id"), tool_name(F.col("p.name")).alias("name"), F.coalesce("p.arguments", "p.input").alias("input")))
    called = _shape(p.filter("p.type in ('function_call', 'custom_tool_call')"), "codex", type=F.lit("assistant"), ts=F.col("at"), text=F.lit(""), tool_calls=call)
    failed = codex_failed(F.col("p.output"))
    result = _shape(p.filter("p.type in ('function_call_output', 'custom_tool_call_output')"), "codex", type=F.lit("tool_result"), ts=F.col("at"), text=F.col("p.output"), tool_use_id=F.col("p.call_id"), is_error=F.coalesce(failed, F.lit(False)))
    return message.unionByName(called).unionByName(result)


def grok(rows: DataFrame) -> DataFrame:
    """Chat history: user rows with text blocks, assistant rows with calls as strings of arguments, result rows."""
    schema = "type string, content string, model_id string, synthetic_reason string, tool_call_id string, tool_calls array<struct<id:string,name:string,arguments:string>>"
    p = rows.withColumn("j", F.from_json("line", schema)).filter("j.type in ('user', 'assistant', 'tool', 'tool_result')")
    said = F.coalesce(_text(_blocks(F.col("j.content"))), F.col("j.content"))
    user = _shape(p.filter("j.type = 'user'").withColumn("asked", prompt(said)).filter("asked is not null"), "grok", type=F.lit("user"), text=F.col("asked"))
    calls = F.transform("j.tool_calls", lambda c: F.struct(c["id"].alias("id"), tool_name(c["name"]).alias("name"), c["arguments"].alias("input")))
    assistant = _shape(p.filter("j.type = 'assistant'"), "grok", type=F.lit("assistant"), text=F.coalesce("j.content", F.lit("")), tool_calls=calls, model=F.col("j.model_id"))
    result = _shape(p.filter("j.type in ('tool', 'tool_result')"), "grok", type=F.lit("tool_result"), text=F.col("j.content"), tool_use_id=F.col("j.tool_call_id"), is_error=F.coalesce(F.col("j.content").rlike(ERROR_TEXT), F.lit(False)))
    return user.unionByName(assistant).unionByName(result)


def fx(rows: DataFrame) -> DataFrame:
    """Rows of one event each: user, assistant, tool_call, tool_result, turn_completed; calls are turns of their own here."""
    schema = "timestamp_ms long, event struct<user:struct<text:string>,assistant:struct<text:string>,tool_call:struct<call_id:string,tool_name:string,arguments_json:string>,tool_result:struct<call_id:string,tool_name:string,status:string,preview:string>>"
    p = rows.withColumn("j", F.from_json("line", schema)).withColumns({"e": F.col("j.event"), "at": F.timestamp_millis(F.col("j.timestamp_ms"))})
    user = _shape(p.filter("trim(e.user.text) <> ''"), "fx", type=F.lit("user"), ts=F.col("at"), text=F.trim("e.user.text"))
    assistant = _shape(p.filter("e.assistant is not null"), "fx", type=F.lit("assistant"), ts=F.col("at"), text=F.coalesce("e.assistant.text", F.lit("")))
    alias = F.coalesce(*(F.when(F.col("e.tool_call.tool_name") == a, b) for a, b in FX_TOOLS.items()), F.col("e.tool_call.tool_name"))
    call = F.array(F.struct(F.col("e.tool_call.call_id").alias("id"), tool_name(alias).alias("name"), F.col("e.tool_call.arguments_json").alias("input")))
    called = _shape(p.filter("e.tool_call is not null"), "fx", type=F.lit("assistant"), ts=F.col("at"), text=F.lit(""), tool_calls=call)
    r = p.filter("e.tool_result is not null").withColumn("shell", F.from_json("e.tool_result.preview", "exit_code int, output_delta string, output string, error string"))
    shell = (F.col("e.tool_result.tool_name") == "shell") & F.col("e.tool_result.preview").startswith("{") & F.col("shell").isNotNull()
    code = F.when(shell, F.col("shell.exit_code"))
    out = F.regexp_replace(F.array_join(F.filter(F.array("shell.output_delta", "shell.output", "shell.error"), lambda x: x.isNotNull() & (x != "")), "\n"), "\n$", "")
    shown = F.when(shell, F.concat(out, F.when(code != 0, F.concat(F.when(out != "", "\n").otherwise(""), F.lit("[exit code: "), code.cast("string"), F.lit("]"))).otherwise(""))).otherwise(F.coalesce("e.tool_result.preview", F.lit("")))
    failed = F.coalesce(F.col("e.tool_result.status") != "success", F.lit(False)) | F.coalesce(code != 0, F.lit(False))
    return user.unionByName(assistant).unionByName(called).unionByName(_shape(r, "fx", type=F.lit("tool_result"), ts=F.col("at"), text=shown, tool_use_id=F.col("e.tool_result.call_id"), is_error=failed))


def dsh(rows: DataFrame) -> DataFrame:
    schema = f"type string, time long, data struct<content:string,source:struct<kind:string>,reason:struct<kind:string,error:struct<message:string,code:string>>,usage:struct<inputTokens:long,outputTokens:long,cacheReadTokens:long,cacheWriteTokens:long>,message:struct<content:string,toolCallId:string,isError:boolean,source:struct<model:string,callId:string>>>"
    p = rows.withColumn("j", F.from_json("line", schema)).withColumns({"d": F.col("j.data"), "at": F.timestamp_millis(F.col("j.time"))})
    text = lambda c: F.coalesce(_text(_blocks(c)), F.lit(""))
    user = _shape(p.filter("j.type = 'user/message' and d.source.kind = 'user'").withColumn("said", F.trim(text(F.col("d.content")))).filter("said <> ''"), "dsh", type=F.lit("user"), ts=F.col("at"), text=F.col("said"))
    parts = F.from_json("d.message.content", "array<struct<type:string,id:string,name:string,arguments:string>>")
    calls = F.transform(F.filter(parts, lambda x: x["type"] == "tool-call"), lambda x: F.struct(x["id"].alias("id"), tool_name(x["name"]).alias("name"), x["arguments"].alias("input")))
    n = lambda f: F.coalesce(F.col(f"d.usage.{f}"), F.lit(0))
    usage = F.struct((n("inputTokens") + n("cacheReadTokens") + n("cacheWriteTokens")).alias("input"), n("outputTokens").alias("output"), n("cacheReadTokens").alias("cache_read"), n("cacheWriteTokens").alias("cache_write"))
    assistant = _shape(p.filter("j.type = 'assistant/message'"), "dsh", type=F.lit("assistant"), ts=F.col("at"), text=text(F.col("d.message.content")), tool_calls=calls, model=F.col("d.message.source.model"), usage=usage)
    result = p.filter("j.type = 'tool/result'").withColumn("said", text(F.col("d.message.content")))
    failed = F.coalesce("d.message.isError", F.lit(False)) | F.col("said").rlike(r"(?m)^\[?exit code:? [1-9]")
    answer = _shape(result, "dsh", type=F.lit("tool_result"), ts=F.col("at"), text=F.col("said"), tool_use_id=F.coalesce("d.message.toolCallId", "d.message.source.callId"), is_error=failed)
    ended = _shape(p.filter("j.type = 'turn/end' and d.reason.kind = 'error'"), "dsh", type=F.lit("tool_result"), ts=F.col("at"), text=F.concat(F.lit("Error: "), F.coalesce("d.reason.error.message", "d.reason.error.code", F.lit("turn failed"))), is_error=F.lit(True))
    return user.unionByName(assistant).unionByName(answer).unionByName(ended)


READERS = {"claude": claude, "cursor-cloud": claude, "cursor": cursor, "factory": factory, "codex": codex, "grok": grok, "vktr": grok, "fx": fx, "dsh": dsh}


def events_of(rows: DataFrame, source: str) -> DataFrame:
    """Events of the lines (path, seq, line) of one source; an unknown source is an error."""
    if source not in READERS:
        raise ValueError(f"unknown source: {source}")
    return READERS[source](rows.filter(indexed(source, F.col("line")))).withColumn("source", F.lit(source))


def read_recordings(spark: SparkSession, pattern: str, source: str | None = None) -> DataFrame:
    """Events of all files of a pattern; no source means claude."""
    rows = zstd_lines(spark, pattern) if pattern.endswith((".zstd", ".zst")) else lines(spark, pattern)
    return events_of(rows, source or "claude")


def read_all(spark: SparkSession, patterns: dict[str, str]) -> DataFrame:
    """Events of several sources (source to pattern) as one table."""
    return reduce(DataFrame.unionByName, (read_recordings(spark, p, s) for s, p in patterns.items()))


def first_frames(data: bytes, most: int) -> bytes:
    """What the first ``most`` whole frames hold."""
    import zstandard

    out, left = [], data
    while left and len(out) < most:
        d = zstandard.ZstdDecompressor().decompressobj()
        try:
            part = d.decompress(left)
        except zstandard.ZstdError:
            break
        if not d.eof:
            break
        out.append(part)
        left = d.unused_data
    return b"".join(out)


def zstd_lines(spark: SparkSession, pattern: str, frames: int = 2**31) -> DataFrame:
    """(path, seq, line) of files of zstd frames, of the first ``frames`` of each; a file is read by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                text = first_frames(bytes(data), frames).decode("utf-8", "replace").splitlines()
                yield pd.DataFrame({"path": path, "seq": range(len(text)), "line": text})

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(run, "path string, seq long, line string")


class SqliteReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.path, self.table = schema, options["path"], options["dbtable"]
        self.parts = int(options.get("numpartitions", "1"))

    def partitions(self) -> list[InputPartition]:
        import glob

        named = re.sub(r"^file:/+", "/", self.path)
        return [InputPartition((f, i)) for f in sorted(glob.glob(named)) or [named] for i in range(self.parts)]

    def read(self, partition: InputPartition):
        import sqlite3
        from contextlib import closing

        names = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        file, part = partition.value
        with closing(sqlite3.connect(f"file:{file}?mode=ro", uri=True)) as db:
            yield from db.execute(f'select {names} from "{self.table}" where rowid % ? = ?', (self.parts, part))


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").schema(...).option("path", ...).option("dbtable", ...).load()``: one database table.

    ``numpartitions`` readers share the rows of a file; ``path`` may be a pattern of several files with the same table.
    They must lie where executors see them.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        raise ValueError("give a schema")

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(schema, self.options)


def opencode_sessions(session: DataFrame, message: DataFrame, least: int = 3, most: int = 10_000) -> DataFrame:
    """The newest sessions with enough messages; a session's size is 1024 for each of them."""
    n = message.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("messages"))
    return session.join(n, "id").filter(F.col("messages") >= least).withColumn("size", F.col("messages") * 1024).orderBy(F.desc("time_updated"), "id").limit(most)


def opencode(message: DataFrame, part: DataFrame) -> DataFrame:
    """Events of messages (id, session_id, time_created, data) and their parts (id, message_id, time_created, data).

    Both keep JSON in ``data``. A message without parts stays. ``seq`` numbers a session's events by the times of
    messages and parts.
    """
    m = message.select(F.col("id").alias("message_id"), F.col("session_id").alias("path"), F.col("time_created").alias("at"), F.from_json("data", "role string, modelID string, time struct<created:long>").alias("m"))
    p = part.select("message_id", F.col("time_created").alias("part_at"), F.col("id").alias("part_id"), F.from_json("data", "type string, text string, content string, callID string, tool string, state struct<status:string,input:string,output:string,error:string>").alias("p"))
    both = m.join(p, "message_id", "left")
    order = F.struct("part_at", "part_id")
    said = F.filter(F.array_sort(F.collect_list(F.when(F.col("p.type") == "text", F.struct(order.alias("k"), F.coalesce("p.text", "p.content").alias("t"))))), lambda x: x["t"].isNotNull())
    called = F.array_sort(F.collect_list(F.when(F.col("p.type") == "tool", F.struct(order.alias("k"), F.struct(F.col("p.callID").alias("id"), tool_name(F.col("p.tool")).alias("name"), F.col("p.state.input").alias("input")).alias("c")))))
    turns = both.groupBy("path", "at", "message_id", "m").agg(F.trim(F.array_join(F.transform(said, lambda x: x["t"]), "\n")).alias("text"), F.transform(called, lambda x: x["c"]).alias("calls"))
    ts = F.timestamp_millis("m.time.created")
    user = turns.filter((F.col("m.role") == "user") & displayable(F.col("text"))).select("path", "at", "message_id", F.lit("").alias("part_id"), F.lit("user").alias("type"), ts.alias("ts"), "text", F.lit(None).cast(CALLS).alias("tool_calls"), F.lit(None).cast("string").alias("tool_use_id"), F.lit(None).cast("boolean").alias("is_error"), F.lit(None).cast("string").alias("model"))
    assistant = turns.filter("m.role = 'assistant'").select("path", "at", "message_id", F.lit("~").alias("part_id"), F.lit("assistant").alias("type"), ts.alias("ts"), "text", F.col("calls").cast(CALLS).alias("tool_calls"), F.lit(None).cast("string").alias("tool_use_id"), F.lit(None).cast("boolean").alias("is_error"), F.col("m.modelID").alias("model"))
    answer = F.coalesce(F.nullif(F.col("p.state.output"), F.lit("")), F.when(F.col("p.state.status") == "error", F.col("p.state.error")), F.lit(""))
    failed = F.coalesce((F.col("p.state.status") == "error") | F.col("p.state.output").rlike(ERROR_TEXT), F.lit(False))
    result = both.filter("m.role = 'assistant' and p.type = 'tool'").select("path", "at", "message_id", F.concat_ws(" ", F.lpad(F.col("part_at").cast("string"), 20, "0"), "part_id").alias("part_id"), F.lit("tool_result").alias("type"), ts.alias("ts"), answer.alias("text"), F.lit(None).cast(CALLS).alias("tool_calls"), F.col("p.callID").alias("tool_use_id"), failed.alias("is_error"), F.lit(None).cast("string").alias("model"))
    every = user.unionByName(assistant).unionByName(result)
    seq = F.row_number().over(Window.partitionBy("path").orderBy("at", "message_id", "part_id"))
    return _shape(every.withColumn("seq", seq), "opencode", **{c: F.col(c) for c in ("type", "ts", "text", "tool_calls", "tool_use_id", "is_error", "model")})


def cursor_models(pairs: DataFrame) -> DataFrame:
    """(id, model) from the (key, value) pairs of an editor's state database: what each composer was set to."""
    composer = pairs.filter(F.col("key").startswith("composerData:"))
    model = F.nullif(F.get_json_object(F.col("value").cast("string"), "$.modelConfig.modelName"), F.lit(""))
    return composer.select(F.substring("key", 14, 1000).alias("id"), model.alias("model")).filter("model is not null")
