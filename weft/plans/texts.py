"""Queries on search, redaction, chapters of conversations and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import redact, text
from weft.operators import chapters, insights, search
from weft.plans.base import query, read, stored_index

TOKENS = r"""list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(coalesce(text, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z0-9])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) between 2 and 32)"""
POSTINGS = f"""t as (select doc_id, {TOKENS} as terms from documents), dl as (select doc_id, len(terms) as dl from t), p as (select doc_id, term, count(*) as tf from (select doc_id, unnest(terms) as term from t) group by all),
 s as (select count(*) as n, avg(dl) as avgdl from dl)"""
WORDS = ["the", "of", "with"]


@query(f"with {POSTINGS} select term, count(*) as df, cast(sum(tf) as bigint) as total from p group by term")
def vocabulary(spark, d):
    return stored_index(spark, d).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


@query(f"with {POSTINGS} select n, round(avgdl, 6) as avgdl from s")
def corpus_statistics(spark, d):
    return stored_index(spark, d).lengths.agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"))


@query(f"""with {POSTINGS}, h as (select p.*, count(*) over (partition by term) as df from p where term in ('the', 'of', 'with')),
  x as (select doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from h join dl using (doc_id), s group by doc_id having count(*) = 3)
  select doc_id, round(score, 6) as score from x order by round(score, 6) desc, doc_id limit 20""")
def bm25_top20(spark, d):
    index = stored_index(spark, d)
    found = search.bm25(index.postings, index.lengths, search.plain(WORDS, spark), len(WORDS)).withColumn("score", F.round("score", 6))
    return found.orderBy(F.desc("score"), "doc_id").limit(20)


@query()
def fuzzy_search(spark, d):
    """A misspelt word, and the beginning of another."""
    return search.search(read(spark, d, "documents"), ["worthles", "idi"], index=stored_index(spark, d))


@query("select doc_id, length(text) as n_chars from documents where contains(lower(text), 'of the')")
def phrase_matches(spark, d):
    docs = read(spark, d, "documents")
    return docs.filter(F.lower("text").contains("of the")).select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query("""with t as (select doc_id, text, position('the' in lower(text)) as a from documents), c as (select doc_id, a, greatest(a - 40, 1) as s, a + 62 as e, text from t where a > 0)
  select doc_id, (case when s > 1 then '…' else '' end) || trim(regexp_replace(substring(text, s, e - s + 1), '\\s+', ' ', 'g')) || (case when e < length(text) then '…' else '' end) as snippet from c""".replace("\\\\", "\\"))
def search_snippets(spark, d):
    return read(spark, d, "documents").select("doc_id", text.snippet(F.col("text"), "the").alias("snippet")).filter("snippet is not null")


@query(f"""with {POSTINGS}, v as (select distinct term from p where length(term) >= 4), g as (select term, list_distinct(list_transform(range(1, length(term) + 3), lambda i: substring('  ' || term || '  ', i, 3))) as g from v),
  q as (select 'worthles' as word, list_distinct(list_transform(range(1, 11), lambda i: substring('  worthles  ', i, 3))) as qg), j as (select word, term, len(list_intersect(g, qg)) / len(list_distinct(list_concat(g, qg))) as w from g, q)
  select word, term, round(w, 9) as weight from j where w >= 0.4 order by w desc, term limit 3""")
def similar_terms(spark, d):
    index = stored_index(spark, d)
    long_ = F.length("term") >= 4
    return search.resolve(index.vocabulary.filter(long_), ["worthles"], prefix_last=False, stored=index.trigrams.filter(long_)).withColumn("weight", F.round("weight", 9))


@query("""with r as (select doc_id, source, lang from documents), t(q) as (values ('src1'), ('en')), x as (select doc_id, q, greatest(case when source = q then 35 when starts_with(source, q) then 35 when contains(source, q) then 20 else 0 end,
  case when contains(lang, q) then 15 else 0 end) as w from r, t) select doc_id, cast(sum(w) as bigint) as score from x group by doc_id having min(w) > 0 order by score desc, doc_id limit 8""")
def catalog_ranking(spark, d):
    """Every word of the query must hit; the best field of each counts."""
    hit = lambda w: F.greatest(F.when(F.col("source").startswith(w), 35).when(F.col("source").contains(w), 20).otherwise(0), F.when(F.col("lang").contains(w), 15).otherwise(0))
    rows = read(spark, d, "documents").select("doc_id", hit("src1").alias("a"), hit("en").alias("b")).filter("a > 0 and b > 0")
    return rows.select("doc_id", (F.col("a") + F.col("b")).cast("long").alias("score")).orderBy(F.desc("score"), "doc_id").limit(8)


@query("select distinct term from (with " + POSTINGS + " select term from p where doc_id % 2 = 0 intersect select term from p where doc_id % 2 = 1)")
def shared_terms(spark, d):
    p = stored_index(spark, d).postings
    return p.filter("doc_id % 2 = 0").select("term").intersect(p.filter("doc_id % 2 = 1").select("term"))


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def pending_analysis(spark, d):
    return search.stale(read(spark, d, "documents").select(F.col("doc_id").alias("path"), "lang", F.lit(1).alias("mtime")), read(spark, d, "labels").select(F.col("doc_id").alias("path"), F.lit(1).alias("mtime"))).select(F.col("path").alias("doc_id"), "lang")


@query()
def redacted_texts(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    out = docs.withColumn("clean", redact.fully_redacted(F.col("text"))).filter(F.col("clean") != F.col("text"))
    return out.select("doc_id", ((F.length("clean") - F.length(F.replace(F.col("clean"), F.lit(redact.MARK), F.lit("")))) / len(redact.MARK)).cast("long").alias("n_marks"))


@query()
def secret_findings(spark, d):
    return redact.findings(read(spark, d, "documents"), "doc_id", "text")


@query("select conv_id, turn, cast(sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as bigint) as chapter from conversations")
def conversation_chapters(spark, d):
    return chapters.with_chapters(read(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "chapter")


@query("""with c as (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as chapter from conversations),
  g as (select conv_id, cast(chapter as bigint) as chapter, count(*) as turns, cast(sum(length(text)) as bigint) as chars, count(*) filter (role = 'assistant') as replies from c group by all)
  select *, lead(turns) over (partition by conv_id order by chapter) as next_turns, round(chars / avg(chars) over (partition by conv_id), 6) as relative from g""")
def chapter_summary(spark, d):
    from pyspark.sql import Window

    c = chapters.with_chapters(read(spark, d, "conversations"), "conv_id", "turn")
    g = c.groupBy("conv_id", "chapter").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("role") == "assistant").alias("replies"))
    w = Window.partitionBy("conv_id")
    return g.withColumns({"next_turns": F.lead("turns").over(w.orderBy("chapter")), "relative": F.round(F.col("chars") / F.avg("chars").over(w), 6)})


@query("""with f as (select *, case when role = lag(role) over (partition by conv_id order by turn) then 0 else 1 end as flip from conversations), i as (select *, sum(flip) over (partition by conv_id order by turn rows unbounded preceding) as message from f)
  select conv_id, cast(message as bigint) as message, role, string_agg(coalesce(text, ''), chr(10) || chr(10) order by turn) as content from i group by all""")
def message_export(spark, d):
    return chapters.merged_messages(read(spark, d, "conversations"))


@query("select conv_id, string_agg('## ' || role || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) order by turn) as markdown from conversations group by conv_id")
def markdown_export(spark, d):
    return chapters.as_markdown(read(spark, d, "conversations"))


@query()
def json_export(spark, d):
    return chapters.as_json(chapters.merged_messages(read(spark, d, "conversations")))


def _chapter_files(spark, d):
    """Orders as chapters of a customer, their parts (in groups) as files."""
    from pyspark.sql import Window

    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    files = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey") % 50)).alias("files"), F.count_if(F.col("l_returnflag") == "R").alias("errors"))
    idx = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    return o.join(files, o.o_orderkey == files.l_orderkey).select(F.col("o_custkey").alias("path"), idx.alias("idx"), "files", "errors", F.when(F.col("errors") >= 3, "struggling").otherwise("clean").alias("outcome"))


FILES = """f as (select o_custkey as path, o_orderkey, l_partkey % 50 as file, sum(case when l_returnflag = 'R' then 1 else 0 end) over (partition by o_orderkey) as errors from orders join lineitem on l_orderkey = o_orderkey),
 k as (select path, o_orderkey, errors, dense_rank() over (partition by path order by o_orderkey) as idx, file from f), u as (select distinct * from k), n as (select path, idx, count(*) as n_files from u group by all)"""


@query(f"""with {FILES}, l as (select a.path, a.idx, b.idx as prev_idx, count(*) as shared, any_value(n_files) as n_files, any_value(b.errors >= 2) as fixes from u a join n using (path, idx) join u b on a.path = b.path and a.file = b.file and b.idx < a.idx and b.idx >= a.idx - 10 group by 1, 2, 3)
  select path, idx, prev_idx, shared, fixes, (shared >= least(2, n_files) or shared >= n_files * 0.5) and not fixes as continues from l""")
def chapter_links(spark, d):
    return chapters.shared_files(_chapter_files(spark, d))


@query()
def workflow_chains(spark, d):
    return chapters.chains(chapters.shared_files(_chapter_files(spark, d)))


@query("select role, quantile_disc(length(text), 0.5) as q50, quantile_disc(length(text), 0.9) as q90 from conversations where length(text) > 0 group by role")
def message_lengths(spark, d):
    return insights.nearest_rank(read(spark, d, "conversations").withColumn("n", F.length("text").cast("long")), "n", ["role"], [0.5, 0.9]).select("role", *(F.col(q).cast("long").alias(q) for q in ("q50", "q90")))
