"""What session records say, as columns: prompts, tools, commands, paths, results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.text import as_re2, one_line

# Tool names of the different harnesses by their common name.
TOOL_NAMES = {
    "bash": "Bash", "shell": "Bash", "exec_command": "Bash", "execute": "Bash", "run_command": "Bash", "run_terminal_command": "Bash", "write_stdin": "Bash",
    "read_file": "Read", "read": "Read",
    "write_file": "Write", "write": "Write", "create_file": "Write",
    "edit_file": "Edit", "edit": "Edit", "apply_patch": "Edit", "patch": "Edit", "search_replace": "Edit", "strreplace": "Edit",
    "grep": "Grep", "ripgrep": "Grep",
    "glob": "Glob", "list_dir": "Glob", "ls": "Glob",
    "agent": "Agent", "task": "Agent", "taskcreate": "Agent", "taskupdate": "Agent", "dispatch_agent": "Agent", "spawn_subagent": "Agent",
    "wait_commands_or_subagents": "Agent", "get_command_or_subagent_output": "Agent", "kill_command_or_subagent": "Agent",
    "web_search": "WebSearch", "websearch": "WebSearch",
    "web_fetch": "WebFetch", "webfetch": "WebFetch", "browser_tab": "WebFetch",
    "todo_write": "TodoWrite", "todowrite": "TodoWrite",
    "enter_plan_mode": "Plan", "exit_plan_mode": "Plan",
    "askquestion": "Ask", "ask_user_question": "Ask",
    "memory_get": "Memory", "memory_search": "Memory",
}
# Which field of a call's input says what it did, by tool; the first that isn't empty.
INPUT_FIELDS = {
    "Bash": ["command", "cmd"], "Read": ["file_path", "path", "target_file"], "Write": ["file_path", "path", "filePath"], "Edit": ["file_path", "path"], "Glob": ["pattern", "folder", "target_directory"],
    "Skill": ["skill"], "TaskCreate": ["description", "subject"], "WebFetch": ["url"], "WebSearch": ["query"], "ToolSearch": ["query"], "SemanticSearch": ["query"], "Delete": ["path", "file_path"],
}
MCP_FIELDS = ["path", "file_path", "url", "query", "subject", "command", "cmd", "title", "pattern", "message"]
# Kinds of tools by their name in lower-case letters.
TOOL_KINDS = {
    "read": r"^(read|readfile|view|viewimage|notebookread)$",
    "edit": r"^(edit|write|multiedit|applypatch|patch|strreplace|strreplaceeditor|notebookedit|createfile|deletefile)$",
    "search": r"^(grep|glob|rg|search|searchtool|semanticsearch|codebasesearch|toolsearch|find|findfiles)$",
    "web": r"^(websearch|webfetch|fetch|fetchurl|browse)$",
    "wait": r"^(sleep|wait|awaitshell|monitor)$",
    "agent": r"^(agent|task|spawnagent|sendmessage|followuptask|waitagent|listagents|closeagent|taskstop)$",
    "command": r"^(bash|exec|execcommand|shell|run|runcommand|terminal|command|writestdin|bashoutput|killshell)$",
}
# The first reason whose pattern is found.
PULL_REASONS = {
    "connection timed out": "timed out", "connection refused": "connection refused", "host name not found": "could not resolve hostname|name or service not known|nodename nor servname",
    "no route to host": "no route to host|network is unreachable", "host key check failed": "host key verification failed",
    "ssh login refused": "permission denied|too many authentication failures", "connection closed": "connection closed|connection reset",
}
# Lines of a result that differ from call to call, words of a prompt that corrects, places of worktrees.
VOLATILE_LINE = r"(?i)^(?:Chunk ID: \S+|Wall time:? [\d.]+ seconds|Original token count: \d+)$"
FRAMING_LINE = r"(?i)^(?:(?:Exit code|exit:)\s*\d+|Script (?:failed|completed)|Wall time:? [\d.]+ seconds|Output:|Script error:|Chunk ID: \S+|Process exited with code -?\d+|Original token count: \d+)$"
EXIT_LINE = r"(?i)^(?:Process exited with code -?\d+|(?:Exit code|exit:)\s*-?\d+)$"
CORRECTION = r"(?i)\b(no|wrong|idiot|revert|undo|actually|instead)\b|not what"
CHECKOUT = r"^(.*?/(?:\.cursor/worktrees/|\.claude/worktrees/|worktrees/|\.worktrees/)[^/]+/)([^/]*)"
AREA_PARENTS = ["backend", "frontend", "packages", "apps", "services", "src", "tools", "docs", "infra", "libs", "crates"]


def tool_name(raw: Column) -> Column:
    """The common name of a tool; names of MCP tools stay, unknown ones begin with a capital."""
    known = F.create_map(*(F.lit(x) for pair in TOOL_NAMES.items() for x in pair))
    other = F.concat(F.upper(F.substring(raw, 1, 1)), F.substring(raw, 2, 10_000))
    return F.when(F.coalesce(raw, F.lit("")) == "", "unknown").when(raw.startswith("mcp__"), raw).otherwise(F.coalesce(F.element_at(known, F.lower(raw)), other))


def mcp_parts(name: Column) -> Column:
    """(server, tool) of mcp__server__tool; without a second part the rest is both; null for other tools."""
    rest = F.substring(name, 6, 10_000)
    at = F.locate("__", rest)
    both = F.struct(F.when(at > 0, F.substring(rest, F.lit(1), at - 1)).otherwise(rest).alias("server"), F.when(at > 0, F.substring(rest, at + 2, F.length(rest))).otherwise(rest).alias("tool"))
    return F.when(name.startswith("mcp__"), both)


def corrects(prompt: Column) -> Column:
    """Whether a prompt takes back what was done before it."""
    return prompt.rlike(as_re2(CORRECTION))


def first_field(json: Column, fields: list[str]) -> Column:
    return F.coalesce(*(F.nullif(F.get_json_object(json, f"$.{f}"), F.lit("")) for f in fields))


def input_summary(tool: Column, json: Column) -> Column:
    """What a call did, from its input as JSON: the field that says it, else the first 150 characters."""
    field = lambda n: F.coalesce(F.get_json_object(json, f"$.{n}"), F.lit(""))
    said = F.when(tool.startswith("mcp__"), F.coalesce(first_field(json, MCP_FIELDS), F.substring(first_field(json, ["content"]), 1, 100), F.substring(json, 1, 150)))
    for name, fields in INPUT_FIELDS.items():
        said = said.when(tool == name, F.coalesce(first_field(json, fields), F.lit("")))
    said = said.when(tool == "Grep", F.concat(field("pattern"), F.lit(" "), field("path")))
    said = said.when(tool == "Agent", F.coalesce(first_field(json, ["description"]), F.substring(first_field(json, ["prompt"]), 1, 100), F.lit("")))
    said = said.when(tool == "TaskUpdate", F.concat(F.coalesce(first_field(json, ["id", "taskId"]), F.lit("")), F.lit(" → "), field("status")))
    said = said.when(tool == "Await", F.coalesce(F.concat(F.lit("task "), first_field(json, ["task_id"])), F.concat(F.lit("wait "), first_field(json, ["block_until_ms"]), F.lit("ms")), F.lit("")))
    said = said.when(tool == "Ask", F.coalesce(first_field(json, ["questions[0].question", "question"]), F.lit("")))
    return F.when(F.coalesce(json, F.lit("")) == "", "").otherwise(said.otherwise(F.substring(json, 1, 150)))


def displayable(text: Column) -> Column:
    return F.coalesce((text != "") & ~text.startswith("<"), F.lit(False))


def without_leading_blocks(text: Column, tag: str) -> Column:
    """``text`` after the ``<tag>...</tag>`` blocks that it begins with; a block without an end stays."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?s)\A(?:<{tag}>.*?</{tag}>\s*)+", "")


def prompt(text: Column) -> Column:
    """What a user message asks, on one line; null for hidden blocks and empty text."""
    t = F.trim(F.coalesce(text, F.lit("")))
    inner = F.regexp_extract(t, r"(?s)<user_query>\s*(.*?)\s*</user_query>", 1)
    part = lambda tag: F.nullif(one_line(F.regexp_extract(inner, rf"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))
    asked = F.when(inner.contains("<command-args>"), part("command-args")).when(inner.contains("<command-message>"), part("command-message")).when((inner == "") | displayable(inner), one_line(inner))
    return F.when(t.rlike(r"(?s)<user_query>.*</user_query>"), asked).when(displayable(t), one_line(t))


def message_key(text: Column) -> Column:
    """A result's lines without tags, spare blanks and what differs from call to call."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: one_line(F.regexp_replace(x, "</?tool_use_error>", "")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(VOLATILE_LINE)), "\n")


def cause_line(text: Column) -> Column:
    """The line of a failed result that names the failure: the first that isn't framing, else its exit line."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, "</?tool_use_error>", ""))), lambda x: x != "")
    first = lambda keep: F.get(F.filter(lines, keep), F.lit(0))
    return F.substring(F.coalesce(first(lambda x: ~x.rlike(FRAMING_LINE)), first(lambda x: x.rlike(EXIT_LINE)), F.get(lines, F.lit(0)), F.lit("")), 1, 200)


def tool_kind(name: Column) -> Column:
    n = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z]", "")
    return F.coalesce(*(F.when(n.rlike(p), k) for k, p in TOOL_KINDS.items()), F.lit("other"))


def tool_verb(name: Column) -> Column:
    n, kind = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z]", ""), tool_kind(name)
    edited = F.when(n.isin("write", "createfile"), "Wrote").when(n == "deletefile", "Deleted").otherwise("Edited")
    agent = F.when(n.isin("agent", "task", "spawnagent"), "Subagent").when(n.isin("sendmessage", "followuptask"), "Messaged").otherwise("Checked agents")
    own = F.replace(F.regexp_replace(name, "^mcp__.+?__", ""), F.lit("_"), F.lit(" "))
    return F.when(kind == "read", "Read").when(kind == "edit", edited).when(kind == "command", "Ran").when(kind == "search", "Searched").when(kind == "web", F.when(n == "websearch", "Searched the web").otherwise("Fetched")).when(kind == "wait", "Waited").when(kind == "agent", agent).otherwise(own)


def patch_summary(text: Column) -> Column:
    """(files, added, removed) of a patch in the ``*** Begin Patch`` form; null for other texts."""
    lines = F.split(text, "\n")
    header = r"^\*\*\* (?:Update|Add|Delete) File:\s*(.+)$"
    files = F.transform(F.filter(lines, lambda x: x.rlike(header)), lambda x: F.trim(F.regexp_extract(x, header, 1)))
    count = lambda mark: F.size(F.filter(lines, lambda x: x.startswith(mark)))
    return F.when(text.rlike(r"(?m)^\*\*\* Begin Patch"), F.struct(files.alias("files"), count("+").alias("added"), count("-").alias("removed")))


def web_links(text: Column) -> Column:
    """(title, url) of every link object in the output of a web search."""
    link = r'\{"title":"([^"]*?)","url":"([^"]*?)"\}'
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(link), F.lit(1)).alias("title"), F.regexp_extract_all(text, F.lit(link), F.lit(2)).alias("url"))
    return F.transform(both, lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url")))


def git_command(command: Column) -> Column:
    """The first git command of a chain, without ``-C`` options; null if there is none."""
    parts = F.transform(F.split(F.coalesce(command, F.lit("")), "&&|;"), lambda x: F.trim(x))
    first = F.get(F.filter(parts, lambda x: x.startswith("git ")), F.lit(0))
    return F.regexp_replace(first, r"^git\s+(?:-C\s+\S+\s+)+", "git ")


def git_op(command: Column, output: Column) -> Column:
    """(type, name, message, hash) of the git operation that a shell command does; null for other commands.

    ``name`` is the branch, remote or tag. Checkouts of files, or with options that aren't known, are no operation.
    """
    c = git_command(command)
    word = lambda verb: F.nullif(F.regexp_extract(c, rf"^git\s+{verb}\s+(?:-\S+\s+)*([\w./-]+)", 1), F.lit(""))
    made, flag = r"\[([^\s\]]+)\s+([a-f0-9]{7,})\]\s*(.*)", r"""(?:^|\s)(?:-[a-zA-Z]*m|--message)(?:\s+|=)(?:"([^"]*)"|'([^']*)'|(\S+))"""
    out = F.coalesce(output, F.lit(""))
    bare = F.substring(F.regexp_extract(out, r"([a-f0-9]{7,40})", 1), 1, 7)
    given = F.concat(*(F.regexp_extract(c, flag, i) for i in (1, 2, 3)))
    message = F.coalesce(F.nullif(F.trim(F.regexp_extract(out, made, 3)), F.lit("")), F.when(~given.rlike(r"^[\"']?\$\("), F.nullif(given, F.lit(""))))
    moved = r"^git\s+(?:checkout|switch)\s+(?:(?:-q|--quiet|-f|--force)\s+)*"
    created = F.nullif(F.regexp_extract(c, moved + r"(?:-b|-B|-c|-C|--create|--force-create|--orphan)\s+([^\s-]\S*)", 1), F.lit(""))
    switched = F.nullif(F.regexp_extract(c, moved + r"([^\s-]\S*)\s*$", 1), F.lit(""))
    switched = F.when(~(c.rlike(r"^git\s+checkout") & switched.contains(".")), switched)
    op = lambda kind, name=None, text=None, sha=None: F.struct(F.lit(kind).alias("type"), (F.lit(None).cast("string") if name is None else name).alias("name"), (F.lit(None).cast("string") if text is None else F.substring(text, 1, 120)).alias("message"), (F.lit(None).cast("string") if sha is None else sha).alias("hash"))
    return (
        F.when(c.rlike(r"^git\s+commit\b"), op("commit", None, message, F.coalesce(F.nullif(F.regexp_extract(out, made, 2), F.lit("")), F.nullif(bare, F.lit("")))))
        .when(c.rlike(r"^git\s+push\b"), op("push", word("push")))
        .when(created.isNotNull(), op("branch-create", created))
        .when(c.rlike(r"^git\s+(?:checkout|switch)\s"), F.when(switched.isNotNull(), op("branch-switch", switched)))
        .when(c.rlike(r"^git\s+branch\s+[^-\s]"), op("branch-create", word("branch")))
        .when(c.rlike(r"^git\s+merge\b"), op("merge", word("merge")))
        .when(c.rlike(r"^git\s+rebase\b"), op("rebase", word("rebase")))
        .when(c.rlike(r"^git\s+stash\b"), op("stash"))
        .when(c.rlike(r"^git\s+tag\b") & ~c.rlike(r"^git\s+tag\s+-d"), op("tag", word("tag")))
    )


def target_dirs(command: Column) -> Column:
    """The absolute folders that a shell command changes into or works in."""
    return F.regexp_extract_all(command, F.lit(r"""(?:\bcd|\bgit -C|--cwd|--prefix)\s+["']?(/[^\s"';&|)]+)"""), F.lit(1))


def path_bleed(cwd: Column, target: Column) -> Column:
    """Whether ``target`` lies in another checkout of the repository that a session was started in."""
    root = F.regexp_replace(F.coalesce(cwd, F.lit("")), "/+$", "")
    here, there = F.concat(root, F.lit("/")), F.concat(target, F.lit("/"))
    part = lambda path, i: F.nullif(F.regexp_extract(path, CHECKOUT, i), F.lit(""))  # noqa: E731  1: the folder of checkouts, 2: the repository
    own, other, repo = part(here, 1), part(there, 1), part(here, 2)
    inside = F.when(own.isNotNull() & other.isNotNull(), repo.isNotNull() & repo.eqNullSafe(part(there, 2)) & (own != other))
    inside = inside.when(own.isNotNull(), repo.isNotNull() & F.contains(there, F.concat(F.lit("/"), repo, F.lit("/"))))
    inside = inside.when(other.isNotNull(), F.coalesce(part(there, 2), F.lit("")) == F.substring_index(root, "/", -1))
    outside = (root != "") & target.startswith("/") & (target != root) & ~F.startswith(target, here)
    return F.coalesce(outside & F.coalesce(inside, F.lit(False)), F.lit(False))


def repo_area(cwd: Column, target: Column) -> Column:
    """The top folder of a path below ``cwd``, the top two for folders that hold several products; null elsewhere."""
    root = F.regexp_replace(F.coalesce(cwd, F.lit("")), "/+$", "")
    parts = F.filter(F.split(F.substring(target, F.length(root) + 2, F.length(target)), "/"), lambda x: x != "")
    top = F.get(parts, F.lit(0))
    area = F.when(F.size(parts) < 2, "(repo root)").when(top.isin(AREA_PARENTS) & (F.size(parts) > 2), F.concat_ws("/", top, F.get(parts, F.lit(1)))).otherwise(top)
    return F.when((root != "") & F.startswith(target, F.concat(root, F.lit("/"))), area)


def project_label(path: Column) -> Column:
    """The last folder of a path, or of a folder name that joins a path by dashes."""
    return F.substring_index(F.regexp_replace(F.regexp_replace(path, "/+$", ""), "^-", ""), "/", -1)


def pull_reason(error: Column) -> Column:
    text = F.lower(F.coalesce(error, F.lit("")))
    return F.coalesce(*(F.when(text.rlike(p), r) for r, p in PULL_REASONS.items()), F.lit("pull failed"))


def limiting_window(windows: Column) -> Column:
    """The window (id, utilization) used most; the last of equals."""
    return F.aggregate(windows, F.get(windows, F.lit(0)), lambda best, w: F.when(w["utilization"] >= best["utilization"], w).otherwise(best))


def used_and_left(utilization: Column) -> Column:
    used = F.floor(utilization * 100 + 0.5).cast("long")
    return F.when(utilization.isNotNull() & ~F.isnan(utilization), F.struct(used.alias("used"), F.greatest(F.lit(0).cast("long"), 100 - used).alias("left")))


def map_total(counts: Column) -> Column:
    return F.coalesce(F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)).cast("long")), F.lit(0).cast("long"))


def backoff_ms(failures: Column) -> Column:
    """15 minutes, doubled with every further failure, two hours at most."""
    return F.least(F.lit(900_000) * F.pow(F.lit(2.0), F.least(failures, F.lit(10)) - 1), F.lit(7_200_000)).cast("long")


def json_or_empty(text: Column, schema: str = "map<string,string>") -> Column:
    """A JSON object, or an empty one for what isn't."""
    empty = F.from_json(F.lit("{}"), schema)
    return F.when(F.coalesce(text, F.lit("")).rlike(r"^\s*\{"), F.coalesce(F.from_json(text, schema), empty)).otherwise(empty)
