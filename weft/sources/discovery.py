"""Finding recordings below the folders of their sources; contents are read only where they name the project."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.sources.recordings import first_lines


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, rel (below ``root``), parts, size and mtime of all files below ``root``, from the listing alone."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    base = root.removeprefix("file://").rstrip("/") + "/"
    rel = F.substring_index(F.col("path"), base, -1)
    return found.withColumn("rel", rel).withColumn("parts", F.split("rel", "/"))


def project_label(slug: Column) -> Column:
    """The folder that a dash-joined path names: what follows ``-code-``, or the path below the home folder."""
    named = F.regexp_extract(slug, "-code-(.+)$", 1)
    return F.when(named != "", named).otherwise(F.regexp_replace(slug, "^-home-[^-]+-", ""))


def folder_name(cwd: Column, otherwise: str) -> Column:
    label = F.substring_index(F.regexp_replace(F.trim(cwd), "/+$", ""), "/", -1)
    return F.coalesce(F.nullif(label, F.lit("")), F.lit(otherwise))


def decoded(name: Column) -> Column:
    """A URL-encoded folder name; a plus stays one."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _row(found: DataFrame, source: str, project: Column, file: Column, parent: Column | None = None, path: Column | None = None) -> DataFrame:
    return found.select((F.col("path") if path is None else path).alias("path"), project.alias("project"), file.alias("file"), "size", "mtime", F.lit(source).alias("source"), (F.lit(None).cast("string") if parent is None else parent).alias("parent_session"))


def claude_family(spark: SparkSession, root: str, source: str = "claude") -> DataFrame:
    """project/session.jsonl, and project/session/subagents/agent.jsonl below their session."""
    p, n = F.col("parts"), F.size("parts")
    found = files(spark, root).filter(F.col("rel").endswith(".jsonl") & ((n == 2) | ((n == 4) & (F.get(p, F.lit(2)) == "subagents"))))
    return _row(found, source, F.get(p, F.lit(0)), F.element_at(p, -1), F.when(n == 4, F.get(p, F.lit(1))))


def cursor(spark: SparkSession, root: str, source: str = "cursor") -> DataFrame:
    """project/agent-transcripts/id/id.jsonl, and what lies in subagents beside it."""
    p, n = F.col("parts"), F.size("parts")
    id_ = F.get(p, F.lit(2))
    main = (n == 4) & (F.get(p, F.lit(3)) == F.concat(id_, F.lit(".jsonl")))
    found = files(spark, root).filter((F.get(p, F.lit(1)) == "agent-transcripts") & F.col("rel").endswith(".jsonl") & (main | ((n == 5) & (F.get(p, F.lit(3)) == "subagents"))))
    return _row(found, source, F.get(p, F.lit(0)), F.element_at(p, -1), F.when(n == 5, id_))


def _first_line(found: DataFrame, schema: str) -> DataFrame:
    """``found`` with first, the parsed first line of each file; nothing else of it is read."""
    return first_lines(found).withColumn("first", F.from_json("line", schema)).drop("line")


def codex(spark: SparkSession, root: str, source: str = "codex", depth: int = 8) -> DataFrame:
    """rollout-*.jsonl at most ``depth`` folders down; the project is the working folder in the first line.

    ``root`` is resolved before: the listing follows no links.
    """
    found = files(spark, root).filter(F.element_at("parts", -1).rlike(r"^rollout-.*\.jsonl$") & (F.size("parts") <= depth + 1))
    known = _first_line(found, "payload struct<cwd:string>")
    return _row(known, source, folder_name(F.col("first.payload.cwd"), "codex"), F.element_at("parts", -1))


def factory(spark: SparkSession, root: str, source: str = "factory") -> DataFrame:
    found = files(spark, root).filter((F.size("parts") == 2) & F.col("rel").endswith(".jsonl"))
    return _row(found, source, F.coalesce(F.nullif(project_label(F.get("parts", F.lit(0))), F.lit("")), F.lit("factory")), F.element_at("parts", -1))


def grok(spark: SparkSession, root: str, source: str = "grok", home: str = "") -> DataFrame:
    """folder/id/chat_history.jsonl, where the folder's name is an encoded path; a session is the folder ``id``."""
    found = files(spark, root).filter((F.size("parts") == 3) & (F.element_at("parts", -1) == "chat_history.jsonl"))
    project = decoded(F.get("parts", F.lit(0)))
    project = F.regexp_replace(F.replace(project, F.lit(home), F.lit("~")) if home else project, "^~/code/", "")
    return _row(found, source, F.coalesce(F.nullif(project, F.lit("")), F.lit(source)), F.get("parts", F.lit(1)), path=F.regexp_replace("path", "/chat_history.jsonl$", ""))


def _documents(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """(dir, doc): the JSON documents called ``name`` below ``root``, by the session's folder."""
    read = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name)
    base = root.removeprefix("file://").rstrip("/") + "/"
    return read.select(F.substring_index(F.substring_index("_metadata.file_path", base, -1), "/", 1).alias("dir"), F.from_json("value", schema).alias("doc"))


def fx(spark: SparkSession, root: str, source: str = "fx") -> DataFrame:
    """id/events.jsonl; session.json beside it names the folder, subagent/owner.json the parent of a child."""
    found = files(spark, root).filter((F.size("parts") == 2) & (F.element_at("parts", -1) == "events.jsonl")).withColumn("dir", F.get("parts", F.lit(0)))
    meta = _documents(spark, root, "session.json", "workspace_root string, origin_workspace_root string, subagent_child boolean").select("dir", F.col("doc").alias("meta"))
    owner = _documents(spark, root, "owner.json", "parent_id string").select("dir", F.col("doc").alias("owner"))
    known = found.join(meta, "dir", "left").join(owner, "dir", "left")
    return _row(known, source, folder_name(F.coalesce(F.nullif("meta.workspace_root", F.lit("")), "meta.origin_workspace_root"), "fx"), F.col("dir"), F.when(F.col("meta.subagent_child"), F.nullif("owner.parent_id", F.lit(""))))


def dsh(spark: SparkSession, root: str, source: str = "dsh") -> DataFrame:
    """slug/dir/session.v<N>.jsonl.zstd, of which the last by name counts; its first row names the folder."""
    found = files(spark, root).filter((F.size("parts") == 3) & F.element_at("parts", -1).rlike(r"^session\.v\d+\.jsonl(\.zstd)?$"))
    newest = F.row_number().over(Window.partitionBy(F.slice("parts", 1, 2)).orderBy(F.desc(F.element_at("parts", -1))))
    known = _first_line(found.withColumn("r", newest).filter("r = 1").drop("r"), "type string, cwd string")
    return _row(known, source, folder_name(F.when(F.col("first.type") == "session", F.col("first.cwd")), "dsh"), F.get("parts", F.lit(1)))


WALKS = {"claude": claude_family, "cursor": cursor, "cursor-cloud": claude_family, "codex": codex, "factory": factory, "grok": grok, "vktr": grok, "fx": fx, "dsh": dsh}


def discover(spark: SparkSession, roots: dict[str, str], project: str | None = None, host: str | None = None) -> DataFrame:
    """path, project, file, size, mtime, source, parent_session and host of all recordings, newest first.

    ``roots`` gives each source's folder; ``project`` keeps projects that contain it. ``host`` marks an imported tree.
    """
    found = reduce(DataFrame.unionByName, (WALKS[s](spark, root, s) for s, root in roots.items()))
    found = found.filter(F.col("project").contains(project)) if project else found
    return found.withColumn("host", F.lit(host).cast("string")).orderBy(F.desc("mtime"), "path")
