"""Queries on searches over the stored index: phrases, weights of words, the pool and order of a second ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import text
from weft.operators import search
from weft.plans.base import query, read, shared_folder, stored_index
from weft.plans.texts import POSTINGS

WORDS = ["the", "worthless", "with"]
SCORES = f"""{POSTINGS}, q(word) as (values ('the'), ('worthless'), ('with')), hh as (select p.*, count(*) over (partition by term) as df from p where term in (select word from q)), z as (select doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from hh join dl using (doc_id), s group by doc_id),
 w as (select term as word, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) as weight from hh, s group by term)"""


@query(f"with {POSTINGS}, v as (select count(*) as terms from (select distinct term from p)) select (select count(*) from p) as postings, (select cast(sum(tf) as bigint) from p) as total, terms, n as docs, (select cast(sum(dl) as bigint) from dl) as length from v, s")
def index_sizes(spark, d):
    index = search.build_index(read(spark, d, "documents"), shared_folder(spark))
    post = index.postings.agg(F.count("*").alias("postings"), F.sum("tf").alias("total"))
    return post.crossJoin(F.broadcast(index.vocabulary.agg(F.count("*").alias("terms")))).crossJoin(F.broadcast(index.lengths.agg(F.count("*").alias("docs"), F.sum("dl").alias("length"))))


@query(f"with {SCORES}, h as (select doc_id from hh group by doc_id having count(*) = 3), b as (select doc_id, score from z join h using (doc_id) order by score desc, doc_id limit 200) select doc_id, round(score, 6) as score from b join documents using (doc_id) where contains(lower(text), 'of the')")
def phrase_search(spark, d):
    index = stored_index(spark, d)
    found = search.bm25(index.postings, index.lengths, search.plain(WORDS, spark), len(WORDS))
    return search.phrase_verified(found, read(spark, d, "documents"), "of the", 20).withColumn("score", F.round("score", 6))


def _weights(spark, d) -> DataFrame:
    """(word, weight) of the words that aren't in over half of the documents, or are among the query's three rarest."""
    index = stored_index(spark, d)
    n = index.lengths.agg(F.count("*").alias("n"))
    return index.vocabulary.filter(F.col("term").isin(WORDS)).crossJoin(F.broadcast(n)).select(F.col("term").alias("word"), search.bm25_idf(F.col("n"), F.col("df")).alias("weight"))


@query(f"with {SCORES} select word, round(weight, 9) as weight from w")
def word_weights(spark, d):
    return _weights(spark, d).withColumn("weight", F.round("weight", 9))


def _candidates(spark, d) -> tuple[DataFrame, DataFrame]:
    """Documents with any of the words; those of source src1 belong to the project."""
    index = stored_index(spark, d)
    hits = index.postings.filter(F.col("term").isin(WORDS))
    scored = search.bm25(index.postings, index.lengths, search.plain(WORDS, spark), len(WORDS), every_word=False)
    own = read(spark, d, "documents").select("doc_id", F.coalesce(F.col("source") == "src1", F.lit(False)).alias("in_project"))
    return scored.join(own, "doc_id"), hits.select("doc_id", F.col("term").alias("word"), F.col("tf").cast("double").alias("tf"))


@query(f"""with {SCORES}, c as (select doc_id, score, source = 'src1' as in_project from z join documents using (doc_id)), b as (select doc_id from c order by score desc, doc_id limit 30),
  e as (select c.doc_id, c.score, c.in_project, w.word, w.weight, coalesce(hh.tf, 0) as tf from c cross join w left join hh on hh.doc_id = c.doc_id and hh.term = w.word where c.doc_id not in (select doc_id from b)),
  ts as (select doc_id, score, in_project, min(weight * tf / (tf + 1.2)) as weakest, sum(weight * ln(1 + tf)) as total from e group by all)
  select doc_id from b union select doc_id from (select doc_id from ts order by weakest desc, score desc, doc_id limit 10) union select doc_id from (select doc_id from ts where in_project order by total desc, score desc, doc_id limit 15)""")
def rerank_pool(spark, d):
    candidates, tfs = _candidates(spark, d)
    return search.rerank_pool(candidates, tfs, _weights(spark, d), best=30, all_words=10, project=15)


@query()
def reranked_search(spark, d):
    """The whole second ranking: candidates, pool, words that stand together, final order; its first 20."""
    candidates, tfs = _candidates(spark, d)
    weights = _weights(spark, d)
    pool = search.rerank_pool(candidates, tfs, weights)
    known = {r["word"]: r["weight"] for r in weights.collect()}  # one row for each word of the query
    words = [w for w in WORDS if w in known]
    near = search.near_words(read(spark, d, "documents").join(pool, "doc_id"), words, [known[w] for w in words])
    return search.reranked(candidates, near).limit(20)


@query("select doc_id, round(score, 6) as score from (select doc_id, length(text) as score from documents where text is not null order by doc_id desc, score desc limit 20)")
def newest_matches(spark, d):
    """By recency over relevance: the newest documents lead whatever their score."""
    docs = read(spark, d, "documents").filter("text is not null").select("doc_id", F.length("text").cast("double").alias("score"))
    return docs.orderBy(F.desc("doc_id"), F.desc("score")).limit(20)


@query("select doc_id, regexp_replace(text, '(the|of)', '[\\1]', 'gi') as marked from documents where contains(lower(text), 'the')".replace("\\\\", "\\"))
def highlighted_texts(spark, d):
    docs = read(spark, d, "documents").filter(F.lower("text").contains("the"))
    return docs.select("doc_id", search.highlighted(F.col("text"), ["of", "the"]).alias("marked"))


@query("""with c as (select doc_id, source, lang, text, coalesce(text, '') as t from documents), m(q) as (values ('12'), ('src1'), ('the')), x as (select doc_id, q, greatest(case when cast(doc_id as varchar) = q then 100 when starts_with(cast(doc_id as varchar), q) then 70 when contains(cast(doc_id as varchar), q) then 40 else 0 end,
  case when source = q or starts_with(source, q) then 35 when contains(source, q) then 20 else 0 end, case when contains(lower(t), q) then case when length(q) < 3 then 12 else 25 end else 0 end, case when contains(lang, q) then 15 else 0 end) as w from c, m)
  select doc_id, cast(sum(w) as bigint) as score from x group by doc_id having min(w) > 0 order by score desc, doc_id limit 8""")
def palette_ranking(spark, d):
    """Every word must hit; of each the best field counts: id, source, text, language."""
    docs = read(spark, d, "documents")
    scored = docs.select("doc_id", search.field_score(["12", "src1", "the"], id=F.col("doc_id").cast("string"), source=F.col("source"), prompt=F.lower(F.coalesce("text", F.lit(""))), project=F.col("lang")).alias("score"))
    return scored.filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(8)


def _snippet_sql(word: str) -> str:
    at = f"position('{word}' in lower(text))"
    start, end = f"greatest({at} - 40, 1)", f"({at} + {len(word) - 1 + 60})"
    return f"case when {at} > 0 then (case when {start} > 1 then '…' else '' end) || trim(regexp_replace(substring(text, {start}, {end} - {start} + 1), '\\s+', ' ', 'g')) || (case when {end} < length(text) then '…' else '' end) end".replace("\\\\", "\\")


@query("with s as (select doc_id, list_filter([" + ", ".join(map(_snippet_sql, ["the", "of", "with", "worthless"])) + "], lambda x: x is not null) as l from documents), u as (select doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) as l from s) select doc_id, l[1] as first, l[2] as second, cast(least(len(l), 3) as integer) as n from u")
def three_snippets(spark, d):
    """Snippets of the first three words that occur; of equal ones the first. Documents with none of the words have none."""
    found = read(spark, d, "documents").select("doc_id", F.coalesce(text.snippets(F.col("text"), ["the", "of", "with", "worthless"]), F.array().cast("array<string>")).alias("l"))
    return found.select("doc_id", F.get("l", F.lit(0)).alias("first"), F.get("l", F.lit(1)).alias("second"), F.size("l").alias("n"))


@query("select p_partkey, case when p_size = 0 then '' else p_size * 2 || '%' end as share, case when p_retailprice >= 1000 then printf('$%.2f', p_retailprice / 1000) else printf('$%.4f', p_retailprice / 1000) end as cost, case when p_retailprice >= 1000 then printf('%.1fK', p_retailprice / 1000) else cast(cast(floor(p_retailprice) as bigint) as varchar) end as n from part")
def shown_numbers(spark, d):
    p = read(spark, d, "part")
    price = F.col("p_retailprice")
    whole = F.when(price >= 1000, text.compact_number(price)).otherwise(text.compact_number(F.floor(price)))
    return p.select("p_partkey", text.percent(F.when(F.col("p_size") != 0, F.col("p_size") / 50)).alias("share"), text.dollars(price / 1000).alias("cost"), whole.alias("n"))
