"""Queries on what session records say. Records are made from table columns, so the SQL knows the answer by construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import errors, records, text
from weft.plans.base import query, read

# what a case is, the command of it, its output, and (type, name, message, hash) that must be found
GIT = [
    ("'git commit -m \"' || p_name || '\"'", "'[main abc' || lpad(cast(p_partkey as varchar(20)), 4, '0') || '] ' || p_name", "'commit'", "null", "p_name", "'abc' || lpad(cast(p_partkey as varchar(20)), 4, '0')"),
    ("'cd /srv/repo && git commit -qm ''' || p_name || ''''", "''", "'commit'", "null", "p_name", "null"),
    ("'git -C /srv/repo push origin main'", "''", "'push'", "'origin'", "null", "null"),
    ("'git checkout -b feature/' || lower(p_type)", "''", "'branch-create'", "'feature/' || lower(p_type)", "null", "null"),
    ("'git switch topic-' || cast(p_size as varchar(20))", "''", "'branch-switch'", "'topic-' || cast(p_size as varchar(20))", "null", "null"),
    ("'git checkout -- README.md'", "''", "null", "null", "null", "null"),
    ("'git merge --no-ff rel-' || cast(p_size as varchar(20))", "''", "'merge'", "'rel-' || cast(p_size as varchar(20))", "null", "null"),
    ("'make all; git rebase main'", "''", "'rebase'", "'main'", "null", "null"),
    ("'git stash'", "''", "'stash'", "null", "null", "null"),
    ("'git tag v' || cast(p_size as varchar(20))", "''", "'tag'", "'v' || cast(p_size as varchar(20))", "null", "null"),
    ("'ls -la ' || lower(p_type)", "''", "null", "null", "null", "null"),
    ("'git branch wip_' || cast(p_partkey as varchar(20))", "''", "'branch-create'", "'wip_' || cast(p_partkey as varchar(20))", "null", "null"),
]


def _case(i: int) -> str:
    return "case p_partkey % 12 " + " ".join(f"when {k} then {g[i]}" for k, g in enumerate(GIT)) + " end"


def _git(spark, d):
    made = read(spark, d, "part").select("p_partkey", "p_brand", F.expr(_case(0)).alias("command"), F.expr(_case(1)).alias("output"))
    return made.withColumn("op", records.git_op(F.col("command"), F.col("output")))


@query(f"select p_partkey, {_case(2)} as type, {_case(3)} as name, {_case(4)} as message, {_case(5)} as hash from part")
def git_operations(spark, d):
    return _git(spark, d).select("p_partkey", "op.type", "op.name", "op.message", "op.hash")


@query(f"with o as (select p_brand as path, {_case(2)} as type from part) select path, type, count(*) as n from o where type is not null group by all")
def git_timeline(spark, d):
    return _git(spark, d).select(F.col("p_brand").alias("path"), "op.type").filter("type is not null").groupBy("path", "type").agg(F.count("*").alias("n"))


NAMES = list(records.TOOL_NAMES)[::4] + ["mcp__files__read_it", "mcp__solo", "TodoRead", "", "MultiEdit"]


@query("with n as (select p_partkey, [" + ", ".join(f"'{n}'" for n in NAMES) + f"][p_partkey % {len(NAMES)} + 1] as raw from part), k(raw, known) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in records.TOOL_NAMES.items()) + """)
  select p_partkey, case when n.raw = '' then 'unknown' when n.raw[:5] = 'mcp__' then n.raw else coalesce(known, upper(n.raw[1]) || n.raw[2:]) end as name,
  case n.raw when 'mcp__files__read_it' then 'files' when 'mcp__solo' then 'solo' end as server, case n.raw when 'mcp__files__read_it' then 'read_it' when 'mcp__solo' then 'solo' end as tool from n left join k on k.raw = lower(n.raw)""")
def tool_names(spark, d):
    raw = F.get(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % len(NAMES)).cast("int"))
    n = read(spark, d, "part").select("p_partkey", raw.alias("raw"))
    return n.select("p_partkey", records.tool_name(F.col("raw")).alias("name"), records.mcp_parts(F.col("raw")).alias("m")).select("p_partkey", "name", "m.server", "m.tool")


@query("""select o_orderkey, case o_orderkey % 8 when 0 then 'ls ' || o_orderstatus when 1 then '/data/' || o_orderpriority when 2 then o_orderstatus || ' src' when 3 then 'https://x.test/' || o_orderkey when 4 then o_orderkey || ' → done'
  when 5 then 'wait ' || o_orderkey || 'ms' when 6 then 'How about ' || o_orderstatus || '?' else 'q' || o_orderkey end as said from orders""")
def input_summaries(spark, d):
    k, o = F.col("o_orderkey"), read(spark, d, "orders")
    case = lambda *values: F.coalesce(*(F.when(k % 8 == i, v) for i, v in enumerate(values)))
    tool = case(*(F.lit(x) for x in ("Bash", "Read", "Grep", "WebFetch", "TaskUpdate", "Await", "Ask", "mcp__notes__find")))
    made = case(
        F.to_json(F.struct(F.concat(F.lit("ls "), "o_orderstatus").alias("cmd"))), F.to_json(F.struct(F.concat(F.lit("/data/"), "o_orderpriority").alias("path"))), F.to_json(F.struct(F.col("o_orderstatus").alias("pattern"), F.lit("src").alias("path"))),
        F.to_json(F.struct(F.concat(F.lit("https://x.test/"), k).alias("url"))), F.to_json(F.struct(k.cast("string").alias("taskId"), F.lit("done").alias("status"))), F.to_json(F.struct(k.alias("block_until_ms"))),
        F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("How about "), "o_orderstatus", F.lit("?")).alias("question"))).alias("questions"))), F.to_json(F.struct(F.concat(F.lit("q"), k).alias("query"))),
    )
    return o.select("o_orderkey", records.input_summary(tool, made).alias("said"))


@query("""select c_custkey, case c_custkey % 5 when 0 then 'do ' || lower(c_mktsegment) when 1 then c_name || ' now' when 2 then null when 3 then c_name else null end as prompt, c_custkey % 5 in (1) as shown, case when c_custkey % 5 = 4 then c_name else coalesce(raw, '') end as stripped from
  (select *, case c_custkey % 5 when 0 then '<user_query> <command-args>do  ' || lower(c_mktsegment) || '</command-args></user_query>' when 1 then '  ' || c_name || chr(10) || 'now ' when 2 then '<hidden>x</hidden>' when 3 then '<user_query>' || c_name || '</user_query>' end as raw from customer)""".replace("c_custkey % 5 in (1) as shown", "c_custkey % 5 = 1 as shown"))
def prompts(spark, d):
    k = F.col("c_custkey")
    raw = F.when(k % 5 == 0, F.concat(F.lit("<user_query> <command-args>do  "), F.lower("c_mktsegment"), F.lit("</command-args></user_query>"))).when(k % 5 == 1, F.concat(F.lit("  "), "c_name", F.lit("\nnow "))).when(k % 5 == 2, "<hidden>x</hidden>").when(k % 5 == 3, F.concat(F.lit("<user_query>"), "c_name", F.lit("</user_query>")))
    block = F.when(k % 5 == 4, F.concat(F.lit("<ctx>a</ctx> <ctx>b</ctx>\n"), "c_name")).otherwise(raw)
    c = read(spark, d, "customer")
    return c.select("c_custkey", records.prompt(raw).alias("prompt"), records.displayable(raw).alias("shown"), records.without_leading_blocks(block, "ctx").alias("stripped"))


@query("""with s as (select doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) as l from documents) select doc_id, md5(array_to_string(list_filter(l, lambda x: x <> ''), chr(10))) as key, trim(substring(coalesce(list_filter(l, lambda x: x <> '')[1], ''), 1, 200)) as cause from s
""".replace("\\\\", "\\"))
def message_keys(spark, d):
    """Every second text is framed by lines that a key must drop."""
    framed = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Chunk ID: ab1\nWall time: 2.5 seconds\n<tool_use_error>"), F.coalesce("text", F.lit("")), F.lit("</tool_use_error>\nOriginal token count: 7"))).otherwise(F.col("text"))
    docs = read(spark, d, "documents").select("doc_id", framed.alias("text"))
    return docs.select("doc_id", F.md5(records.message_key(F.col("text"))).alias("key"), F.substring(text.one_line(records.cause_line(F.regexp_replace("text", "[ \t]+", " "))), 1, 200).alias("cause"))


@query("select event_type as name, case event_type when 'view' then 'read' else 'other' end as kind, case event_type when 'view' then 'Read' else event_type end as verb, count(*) as n from events group by 1 union all select 'apply_patch', 'edit', 'Edited', count(*) from part where p_size % 2 = 0 union all select 'mcp__db__run_it', 'other', 'run it', count(*) from part where p_size % 2 = 1")
def tool_kinds(spark, d):
    names = read(spark, d, "events").select(F.col("event_type").alias("name")).unionByName(read(spark, d, "part").select(F.when(F.col("p_size") % 2 == 0, "apply_patch").otherwise("mcp__db__run_it").alias("name")))
    return names.groupBy("name", records.tool_kind(F.col("name")).alias("kind"), records.tool_verb(F.col("name")).alias("verb")).agg(F.count("*").alias("n"))


@query("select p_partkey, 'src/' || lower(p_type) || '.py' as files, p_size as added, p_size % 3 as removed, case when p_partkey % 2 = 0 then 2 else 0 end as links, case when p_partkey % 2 = 0 then 'https://x.test/' || p_partkey end as url from part")
def patches_and_links(spark, d):
    p = read(spark, d, "part")
    body = F.concat(F.lit("*** Begin Patch\n*** Update File: src/"), F.lower("p_type"), F.lit(".py\n@@\n context"), F.repeat(F.lit("\n+new"), F.col("p_size")), F.repeat(F.lit("\n-old"), F.col("p_size") % 3), F.lit("\n*** End Patch"))
    out = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('Links: [{"title":"A","url":"https://x.test/'), F.col("p_partkey"), F.lit('"},{"title":"","url":"https://y.test"}]'))).otherwise("none")
    s, links = records.patch_summary(body), records.web_links(out)
    return p.select("p_partkey", F.array_join(s["files"], ",").alias("files"), s["added"].alias("added"), s["removed"].alias("removed"), F.size(links).alias("links"), F.get(links, F.lit(0))["url"].alias("url"))


@query("""select s_suppkey, case s_suppkey % 4 when 0 then true when 1 then false when 2 then true else false end as bleeds, case when s_suppkey % 4 = 3 then case when s_nationkey % 2 = 0 then 'src/' || s_nationkey else 'lib' || s_nationkey end end as area, '/w/' || s_suppkey as dir from supplier""")
def paths_outside(spark, d):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    cwd = F.when(k % 4 == 2, "/home/me/worktrees/a/repo").otherwise("/home/me/repo")
    inner = F.when(n % 2 == 0, F.concat(F.lit("src/"), n, F.lit("/x/y.py"))).otherwise(F.concat(F.lit("lib"), n, F.lit("/y.py")))
    target = F.when(k % 4 == 0, "/home/me/worktrees/b/repo/f.py").when(k % 4 == 1, "/home/me/worktrees/b/else/f.py").when(k % 4 == 2, "/home/me/worktrees/c/repo/f.py").otherwise(F.concat(F.lit("/home/me/repo/"), inner))
    dirs = records.target_dirs(F.concat(F.lit("cd /w/"), k, F.lit(" && make")))
    return read(spark, d, "supplier").select("s_suppkey", records.path_bleed(cwd, target).alias("bleeds"), records.repo_area(cwd, target).alias("area"), F.get(dirs, F.lit(0)).alias("dir"))


REASONS = [("ssh: connect to host h port 22: Connection timed out", "connection timed out"), ("Connection refused", "connection refused"), ("ssh: Could not resolve hostname h", "host name not found"), ("Permission denied (publickey)", "ssh login refused"), ("Connection reset by peer", "connection closed"), ("rsync error 23", "pull failed")]


@query("with r as (select n_nationkey, [" + ", ".join(f"'{b}'" for _, b in REASONS) + "][n_nationkey % 6 + 1] as reason, n_nationkey % 5 + 1 as failures from nation) select n_nationkey, reason, cast(least(900000 * 2 ** (failures - 1), 7200000) as bigint) as wait_ms, cast(n_nationkey % 3 * 50 as bigint) as used, greatest(0, 100 - n_nationkey % 3 * 50) as left_, case when n_nationkey % 3 = 2 then 'week' when n_nationkey % 3 = 0 then 'day' else 'week' end as limiting, n_nationkey % 4 * 2 + 1 as total from r")
def limits_and_failures(spark, d):
    k = F.col("n_nationkey")
    used = (k % 3) * F.lit(0.5)
    amounts = records.used_and_left(used)
    windows = F.array(F.struct(F.lit("day").alias("id"), F.lit(0.25).cast("double").alias("utilization")), F.struct(F.lit("week").alias("id"), used.cast("double").alias("utilization")))
    return read(spark, d, "nation").select("n_nationkey", records.pull_reason(F.get(F.array(*(F.lit(a) for a, _ in REASONS)), (k % 6).cast("int"))).alias("reason"), records.backoff_ms(k % 5 + 1).alias("wait_ms"), amounts["used"].alias("used"), amounts["left"].alias("left_"), records.limiting_window(windows)["id"].alias("limiting"), records.map_total(F.create_map(F.lit("Bash"), k % 4 * 2, F.lit("Read"), F.lit(1).cast(k_type(spark, d)))).alias("total"))


def k_type(spark, d) -> str:
    return read(spark, d, "nation").schema["n_nationkey"].dataType.simpleString()


@query("select event_id, cast(json_extract_string(props, '$.k') as varchar) as k, false as broken from events where event_id % 3 <> 0 union all select event_id, null, true from events where event_id % 3 = 0")
def decoded_json(spark, d):
    cut = F.when(F.col("event_id") % 3 == 0, F.substring("props", 1, 3)).otherwise(F.col("props"))
    e = read(spark, d, "events").select("event_id", records.json_or_empty(cut).alias("j"))
    return e.select("event_id", F.col("j")["k"].alias("k"), F.col("j")["k"].isNull().alias("broken"))


@query("select source, bit_xor(hash_) as checksum, count(*) as n from (select source, cast('0x' || substring(sha256(coalesce(text, '')), 1, 12) as bigint) as hash_ from documents) group by source")
def list_checksums(spark, d):
    """A checksum of a list that doesn't depend on its order."""
    h = F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 12), 16, 10).cast("long")
    return read(spark, d, "documents").groupBy("source").agg(F.bit_xor(h).alias("checksum"), F.count("*").alias("n"))


@query("select role, count(*) filter (regexp_matches(text, '\\b(no|wrong|idiot|revert|undo|actually|instead)\\b|not what', 'i')) as corrections, count(*) filter (regexp_matches(text, '".replace("\\\\", "\\") + errors.WRONG_FOLDER.removeprefix("(?i)").replace("'", "''") + "', 'i')) as lost from conversations group by role")
def corrections_and_lost_commands(spark, d):
    t = F.coalesce("text", F.lit(""))
    return read(spark, d, "conversations").groupBy("role").agg(F.count_if(records.corrects(t)).alias("corrections"), F.count_if(errors.in_wrong_folder(t)).alias("lost"))


@query("select doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) as words, array_to_string(string_split(coalesce(text, ''), chr(10))[1:2], chr(10)) as head, array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')[1:2], chr(10)) as full_head from documents".replace("\\\\", "\\"))
def line_heads(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", text.count_words(t).cast("long").alias("words"), text.first_lines(t, 2).alias("head"), text.first_lines(t, 2, non_empty=True).alias("full_head"))
