"""Queries on what is kept up to date: segments of an index, insights by session, filters beside files; secret rules."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from weft.functions import ragged, redact, secrets
from weft.operators.insight_store import InsightStore
from weft.operators.phrases import filters, matches, sessions_with
from weft.operators.segments import Segments
from weft.plans.analysis import FACTS, _facts
from weft.plans.base import query, read, shared_folder
from weft.plans.texts import POSTINGS


@query(f"with {POSTINGS} select term, count(*) as df, cast(sum(tf) as bigint) as total, (select count(*) from documents where doc_id % 5 <> 2) as docs from p where doc_id % 5 <> 2 group by term")
def stream_index_segments(spark, d):
    """Documents arrive in nine batches, most with older texts first; a fifth are deleted in the end. At most six
    segments are left, and they hold what an index of the final documents would."""
    out = shared_folder(spark)
    docs, k = read(spark, d, "documents").select("doc_id", "text"), F.col("doc_id")
    for i in range(9):  # a document comes with another text, in two batches of seven, then as it is, then gone
        part = docs.filter(k % 7 == i % 7) if i < 7 else docs if i == 7 else docs.filter(k % 5 == 2)
        text = F.concat(F.lit("an older text "), k.cast("string")) if i < 7 else F.col("text")
        part.select("doc_id", text.alias("text"), F.lit(i).alias("mtime"), F.lit(i == 8).alias("gone")).write.option("compression", "zstd").parquet(f"{out}/in/batch_{i}")
    index = Segments(spark, f"{out}/index", fan=3)
    for i in range(9):
        stream = spark.readStream.schema("doc_id long, text string, mtime int, gone boolean").parquet(f"{out}/in/batch_{i}")
        stream.writeStream.foreachBatch(lambda batch, _, i=i: index.add(batch, i)).option("checkpointLocation", f"{out}/state/{i}").trigger(availableNow=True).start().awaitTermination()
    if len(index.manifest()) > 6:
        raise AssertionError("segments weren't merged")
    post, lengths = index.current()
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).crossJoin(F.broadcast(lengths.agg(F.count("*").alias("docs"))))


NUMBERS, GROUPS, MAPS = ["calls", "errors", "tokens"], ["source", "area"], ["classes"]


@query(f"""with {FACTS}, f as (select *, cast(path as bigint) as k from facts where cast(path as bigint) % 7 <> 1), e as (
  select 'sessions' as name, null as value, 1 as n from f union all select unnest(['calls', 'errors', 'tokens']), null, unnest([calls, errors, tokens]) from f
  union all select 'source.' || unnest(['sessions', 'calls', 'errors', 'tokens']), source, unnest([1, calls, errors, tokens]) from f union all select 'area.' || unnest(['sessions', 'calls', 'errors', 'tokens']), area, unnest([1, calls, errors, tokens]) from f where area is not null
  union all select unnest(['classes', 'classes.sessions']), o_orderpriority, unnest([n, 1]) from (select path, o_orderpriority, count(*) as n from line join f using (o_custkey) where l_returnflag = 'R' group by all) t)
  select name, value, cast(sum(n) as bigint) as n, (select count(*) from f where k % 3 = 0 or k % 5 = 0) as analyzed from e group by name, value having sum(n) <> 0 or value is null""")
def incremental_insights(spark, d):
    """Three runs: four fifths of the sessions; all, every third one changed; and six sevenths of them. The sums are those
    of the last sessions, and the second run analyses what is new or changed alone."""
    facts = _facts(spark, d).select("path", *NUMBERS, *GROUPS, *MAPS)
    store = InsightStore(spark, shared_folder(spark), NUMBERS, GROUPS, MAPS)
    k = F.col("path").cast("long")
    first, later = facts.filter(k % 5 != 0).select("path", F.lit(1).cast("long").alias("mtime")), facts.select("path", F.when(k % 3 == 0, 2).otherwise(1).cast("long").alias("mtime"))

    def old(changed):
        # an older content of the sessions that change
        return facts.join(changed.select("path"), "path", "left_semi").withColumns({c: F.when(k % 3 == 0, F.col(c) * 2 + 1).otherwise(F.col(c)) for c in NUMBERS})

    store.refresh(first, old)
    now = lambda changed: facts.join(changed.select("path"), "path", "left_semi")
    last = later.filter(k % 7 != 1)
    store.refresh(later, now)
    store.refresh(last, now)
    analysed = spark.read.parquet(f"{store.folder}/facts/000001").join(last.select("path"), "path", "left_semi").agg(F.count("*").alias("analyzed"))
    return store.sums().select("name", "value", F.col("n").cast("long").alias("n")).crossJoin(F.broadcast(analysed))


def _escaped(text):
    """A line of JSON that holds ``text`` as a command, every third character as an escape."""

    @F.udf("string")
    def line(t):
        body = "".join(f"\\u{ord(c):04x}" if i % 3 == 0 and ord(c) < 0x10000 else json.dumps(c)[1:-1] for i, c in enumerate(t or ""))
        return '{"type":"assistant","message":{"content":[{"type":"tool_use","name":"Bash","input":{"command":"' + body + '"}}]}}'

    return line(text)


@query("select conv_id, turn from conversations where contains(lower(text), 'of the')")
def escaped_phrase_lines(spark, d):
    """Messages as commands in JSON with escapes; found where the phrase is hidden by them."""
    lines = read(spark, d, "conversations").select("conv_id", "turn", _escaped(F.col("text")).alias("line"))
    return matches(lines, "of the", "conv_id").select("conv_id", "turn")


@query("select distinct conv_id from conversations where contains(lower(text), 'of the')")
def phrase_sessions(spark, d):
    """The same by conversation: filters are kept beside the files, and only files that may match are read."""
    out = shared_folder(spark)
    read(spark, d, "conversations").select("conv_id", _escaped(F.col("text")).alias("line")).repartitionByRange("conv_id").sortWithinPartitions("conv_id").write.parquet(f"{out}/lines")
    lines = spark.read.parquet(f"{out}/lines")
    filters(lines, "conv_id").write.parquet(f"{out}/filters")
    return sessions_with(lines, spark.read.parquet(f"{out}/filters"), "of the", "conv_id")


@query(r"""with t as (select doc_id, trim(regexp_replace(text, '[\x00-\x20]+', ' ', 'g')) as said from documents where text is not null) select doc_id, said, 1 as rank from t where length(said) >= 30
  and not regexp_matches(said, '^/[-._a-zA-Z0-9/]+$|^https?://|^[0-9a-fA-F]{32,}$|^[A-Za-z0-9+/]{40,}={0,2}$') and not (said like '{%' and said like '%}') and not (said like '[%' and said like '%]') and length(regexp_replace(said, '[0-9A-Za-z_\s]', '', 'g')) <= 0.7 * length(said)""")
def fallback_texts(spark, d):
    """Documents as lines of an unknown format, twice each and nested; the texts inside, once a file."""
    docs = read(spark, d, "documents").filter("text is not null")
    inner = F.struct(F.array(F.struct(F.lit("x").alias("type"), F.col("text"))).alias("content"), F.struct(F.lit("a text that stands below no known key").alias("k")).alias("meta"))
    line = F.to_json(F.struct(F.lit("odd").alias("type"), inner.alias("message"), F.col("doc_id").alias("n")))
    lines = docs.select(F.col("doc_id").alias("path"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), line.alias("line"))
    return ragged.fallback_chunks(lines).select(F.col("path").alias("doc_id"), F.col("text").alias("said"), "rank")


#: A hundred rules, one for each last two digits of a customer's name, with lists.
MANY = [secrets.Rule(f"r{i:02d}", rf"\bCustomer#(\d{{7}}{i:02d})\b", (f"{i:02d}", "nothing"), 1, 0.5, (r"^0{8}[1-4]",), ("00013",), (r"^/allowed/",)) for i in range(100)]


@query("""with c as (select c_custkey, c_name, substring(c_name, 10) as s, case when c_custkey % 4 = 0 then '/allowed/' else '/code/' end || c_custkey as path from customer)
  select c_custkey, 'r' || right(s, 2) as rule_id, s as secret from c where c_custkey % 4 <> 0 and not regexp_matches(s, '^0{8}[1-4]') and not contains(s, '00013') and regexp_matches(c_name, '^Customer#[0-9]{9}$')
   and (select -sum(n / 9.0 * log2(n / 9.0)) from (select count(*) as n from (select unnest(string_split(s, '')) as ch) u group by ch) v) >= 0.5""")
def many_secret_rules(spark, d):
    """A hundred rules with keywords, entropy and lists, in one pass over the customers."""
    texts = read(spark, d, "customer").select("c_custkey", F.concat(F.lit("id "), "c_name", F.lit(", again "), "c_name").alias("text"), F.concat(F.when(F.col("c_custkey") % 4 == 0, "/allowed/").otherwise("/code/"), F.col("c_custkey").cast("string")).alias("path"))
    return secrets.scanned(texts, "text", secrets.Rules(MANY), "path").drop("path")


@query("select c_custkey, c_custkey % 3 <> 0 as clean, 2 as marks from customer")
def redacted_rule_secrets(spark, d):
    """What the rules find goes out of JSON too, where it stands: in nested values, behind escapes, never in names."""
    token = F.concat(F.lit("AKIA"), F.upper(F.substring(F.sha2("c_name", 256), 1, 16)))
    body = F.to_json(F.struct(F.struct(F.array(F.concat(F.lit('key "'), token, F.lit('"\n'))).alias("list")).alias("in"), F.concat(F.lit("and "), token).alias("text"), (F.col("c_custkey") % 3 == 0).alias("named")))
    body = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('{"'), token, F.lit('":1,'), F.substring(body, 2, 10_000))).otherwise(body)
    done = redact.redacted_json(read(spark, d, "customer").select("c_custkey", "c_name", body.alias("body")), "body")
    n = (F.length("body") - F.length(F.replace("body", F.lit(redact.MARK), F.lit("")))) / len(redact.MARK)
    return done.select("c_custkey", (~F.col("body").contains(token)).alias("clean"), n.cast("int").alias("marks"))
