"""Classes of failed tool results, and predicates on commands and tools."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.text import as_re2

# Ordered patterns, the first that matches names the class.
ERROR_CLASSES = {
    "harness-block": r"(?i)Blocked:|hook (?:blocked|error|denied)|was rejected|doesn't want to proceed|requires approval|permission to use|operation was aborted|interrupted by user",
    "tool-input": r"(?i)InputValidationError|Invalid tool parameters|is not valid JSON|unknown tool|No such tool|missing required (?:parameter|argument)",
    "edit-mismatch": r"(?i)String to replace not found|Found \d+ (?:matches|occurrences)|has not been read yet|modified since (?:it was )?read|old_str(?:ing)? (?:not found|must)|No changes to make|patch (?:failed|does not apply)|hunk .* failed",
    "disk-full": r"(?i)ENOSPC|No space left on device|Disk quota exceeded",
    "timeout": r"(?i)timed out|timeout (?:of|after|exceeded)|ETIMEDOUT|deadline exceeded|TimeoutError|Timeout \d+ms exceeded|\bTIMEOUT\b|^\s*(?:Exit code|exit:)\s*124\b",
    "killed": r"(?i)^\s*(?:Exit code|exit:)\s*(?:13[07]|14[34])\b|\bSIGKILL\b|\bSIGTERM\b|Killed\s*$|out of memory|OOMKilled",
    "missing-path": r"(?i)No such file or directory|ENOENT|File does not exist|^Error: /\S+ does not exist|FileNotFoundError|Path does not exist|cannot access|Not a directory|file or directory not found",
    "permission": r"Permission denied|EACCES|Operation not permitted|EPERM",
    "command-not-found": r"(?i)command not found|/which: no |is not recognized as|No such command|unknown (?:command|option|flag)|unrecognized (?:option|argument|subcommand)",
    "missing-dep": r"(?i)ModuleNotFoundError|No module named|Cannot find module|ImportError|Cannot find package|ERR_MODULE_NOT_FOUND|could not resolve dependenc",
    "git": r"fatal: |not a git repository|CONFLICT \(|non-fast-forward|failed to push|needs merge|unmerged files",
    "network-auth": r"(?i)\b(?:401|403|429)\b|Unauthorized|Forbidden|ECONNREFUSED|ECONNRESET|Connection refused|Could not resolve host|rate limit|HTTP (?:4|5)\d\d|gh auth login|Bad credentials",
    "lint-type": r"\bRUF\d{3}\b|\b[EFW]\d{3}\b |error TS\d+|\bmypy\b|\bpyright\b|\beslint\b|ruff (?:check|format)|Found \d+ errors?\b|would reformat",
    "test-failure": r"\b\d+ failed\b|AssertionError|=+ FAILURES =+|FAILED [\w./-]+::|Test Files .*failed|\bFAIL\b .*\.(?:test|spec)\.|not ok \d+|# fail [1-9]",
    "syntax": r"(?i)SyntaxError|syntax error|Unexpected token|IndentationError|unexpected EOF|parse error",
    "python-exception": r"Traceback \(most recent call last\)",
    "empty-exit": r"(?i)^\s*(?:Exit code|exit:)\s*\d+\s*$",
    "nonzero-exit": r"(?i)Exit code \d+|exit(?:ed)?(?: with)?(?: code)?:? \d+|returned non-zero",
}
# Results that only look failed, tools, and commands and results of known traps.
SUSPECT = r"(?i)^\s*(?:<workspace_result\b|\d+→|(?:Exit code|exit:)\s*0\b|Script completed\b)|has been (?:updated|created|written) successfully"
SHELL_TOOL = r"(?i)^(?:bash|shell|exec|exec_command|run_terminal_cmd|run_command|execute|local_shell|terminal|monitor)$"
LONG_RUNNING_TOOL = r"(?i)^(?:agent|task|subagent|spawn_agent|wait_agent|taskoutput|bashoutput|startmissionrun|skill|webfetch|web_fetch|websearch|web_search|wait|write_stdin)$"
TEST_RUNNER = r"(?:^|[\s;&|(])(?:pytest|vitest|jest|playwright test|cargo test|go test|(?:npm|pnpm|yarn|bun)(?: run)? test\b|make test|node --test|tox|nox)\b|python3? -m (?:pytest|unittest)|uv run (?:--[\w-]+(?:[= ]\S+)? )*pytest"
CI_WAIT = r"\bgh (?:run (?:watch|view|list|rerun)|pr checks|workflow run)\b|\bgh api [^\n|;]*(?:check-runs|check-suites|actions/runs|commits/[^\s/]+/status)"

FILE_TOOL = r"(?i)^(?:read|edit|write|multiedit|notebookedit|create|str_replace|str_replace_editor|apply_patch|view|read_file|write_file|edit_file|search_replace)$"
WRITE_TOOL = r"(?i)^(?:edit|write|multiedit|notebookedit|create|str_replace|str_replace_editor|apply_patch|write_file|edit_file|search_replace)$"
WRONG_FOLDER = r"(?i)not a git repository|\bcd: .*No such file or directory|can't cd to|(?:package\.json|pyproject\.toml|Cargo\.toml|Makefile|go\.mod|uv\.lock)['\"`]?[^\n]{0,60}(?:No such file|not found|ENOENT|does not exist)|(?:No such file|ENOENT|Could not (?:find|read))[^\n]{0,80}(?:package\.json|pyproject\.toml|Cargo\.toml|go\.mod)|No rule to make target|ERROR: file or directory not found|No (?:`?pyproject\.toml`?|package\.json) found|could not find `?Cargo\.toml`?|Missing script:"


def error_class(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.coalesce(*(F.when(text.rlike(p), name) for name, p in ERROR_CLASSES.items()), F.lit("other"))


def is_suspect(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(SUSPECT)


def in_wrong_folder(text: Column) -> Column:
    """Whether a failed result says that its command ran in a folder that isn't the one it was meant for."""
    return text.rlike(as_re2(WRONG_FOLDER))


def is_long_running(tool: Column) -> Column:
    tool = F.coalesce(tool, F.lit(""))
    return tool.rlike(SHELL_TOOL) | tool.rlike(LONG_RUNNING_TOOL) | tool.startswith("mcp__")


def sleep_seconds(command: Column) -> Column:
    """The sum of all ``sleep N``, with units s, m and h."""
    found = F.regexp_extract_all(command, F.lit(r"\bsleep\s+(\d+(?:\.\d+)?[smh]?)\b"), F.lit(1))
    one = lambda x: F.regexp_extract(x, r"^([\d.]+)", 1).cast("double") * F.when(x.endswith("h"), 3600).when(x.endswith("m"), 60).otherwise(1)
    return F.aggregate(found, F.lit(0.0), lambda acc, x: acc + one(x))


def first_class_sql(column: str) -> str:
    """The same CASE for an engine with RE2 patterns, whose flags go to the function."""
    arms = (f"when regexp_matches({column}, '{p.removeprefix('(?i)').replace(chr(39), chr(39) * 2)}'{', ' + chr(39) + 'i' + chr(39) if p.startswith('(?i)') else ''}) then '{name}'" for name, p in ERROR_CLASSES.items())
    return "case " + " ".join(arms) + " else 'other' end"


def any_match(text: Column, *patterns: str) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(text, F.lit("")).rlike(p) for p in patterns))
