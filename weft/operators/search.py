"""Full-text search over ordinary tables: postings, BM25, fuzzy terms, phrases, index maintenance."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from weft.functions.text import TOKEN_SPLIT, tokens, trigrams

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf)."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def doc_lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, dl); documents without terms have length 0 and count towards the average."""
    return docs.select(key, F.size(tokens(F.col(text))).cast("long").alias("dl"))


class Index:
    """A stored index: postings (key, term, tf) sorted by term, so that a read of some terms skips row groups by their
    statistics; lengths (key, dl); the vocabulary (term, df); and its trigrams (trigram, term, n) sorted by trigram."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/postings")

    @property
    def lengths(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/lengths")

    @property
    def vocabulary(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/vocabulary")

    @property
    def trigrams(self) -> DataFrame:
        """Cut from the vocabulary by the first search that needs them, and kept."""
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/trigrams/_SUCCESS")
        if not done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            terms = self.vocabulary.select("term", trigrams(F.col("term")).alias("g"))
            cut = terms.select(F.explode("g").alias("trigram"), "term", F.size("g").alias("n"))
            # as many rows as the vocabulary has characters: by hash, so that no sample of it is cut first
            cut.repartition("trigram").sortWithinPartitions("trigram", "n", "term").write.mode("overwrite").parquet(f"{self.folder}/trigrams")
        return self.spark.read.parquet(f"{self.folder}/trigrams")


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf) of all terms, and a null term with tf 0 for every document."""
    parts = docs.select(key, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), TOKEN_SPLIT)).alias("part"))
    # terms are lower-cased and counted as rows, in compiled code; each document's own parts meet before the exchange
    terms = parts.select(key, F.when(F.length("part").between(2, 32), F.lower("part")).alias("term"))
    return terms.groupBy(key, "term").agg(F.count("term").alias("tf"))


#: Where a term begins inside a word, as in ``TOKEN_SPLIT``; and bytes as they stand in terms, others as spaces.
INNER = re.compile(rb"[A-Z](?:(?<=[a-z0-9][A-Z])|(?<=[A-Z][A-Z])(?=[a-z0-9]))")
IN_TERMS = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in bytes(range(256)).lower())


def counted_rows(docs: DataFrame, key: str, text: str, *kept: str, most: int = 400_000) -> DataFrame:
    """(key, row, term, tf, kept columns): the terms of each row of ``docs``, and a null term whose tf is the number of them.

    ``row`` numbers the rows, which may share a key. Only the null terms have the kept columns. Texts are neither
    exchanged nor looked at twice: a row is counted where it is read, and handed on by about ``most`` terms, in their order,
    so that equal ones take less room in what follows and are sorted in fewer steps.
    """
    fields = [docs.schema[key], StructField("row", LongType()), StructField("term", StringType()), StructField("tf", LongType()), *(StructField(c, docs.schema[c].dataType) for c in kept)]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = TaskContext.get().partitionId() << 40
        for batch in batches:
            at, sizes, terms, tfs = 0, [], [], []

            def flush():
                first = np.cumsum([0, *sizes[:-1]])
                of = np.repeat(np.arange(at, at + len(sizes)), sizes)
                inner = np.ones(len(of), bool)
                inner[first] = False
                own = pa.array(of, pa.int64(), mask=inner)
                columns = [pc.take(batch.column(key), pa.array(of)), pa.array(done + of), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64())]
                rows = pa.RecordBatch.from_arrays([*columns, *(pc.take(batch.column(c), own) for c in kept)], names)
                return rows.take(pc.sort_indices(columns[2]))

            for body in batch.column(text).cast(pa.binary()):
                body = body.as_py() or b""
                words = Counter(INNER.sub(rb" \g<0>", body).translate(IN_TERMS).split())
                for w in [w for w in words if len(w) == 1 or len(w) > 32]:
                    del words[w]
                sizes.append(len(words) + 1)
                terms += [None, *words]
                tfs += [sum(words.values()), *words.values()]
                if len(terms) >= most:
                    yield flush()
                    at, sizes, terms, tfs = at + len(sizes), [], [], []
            if sizes:
                yield flush()
            done += batch.num_rows

    return docs.select(key, text, *kept).mapInArrow(run, StructType(fields))


def sorted_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


def spread(docs: DataFrame) -> DataFrame:
    """``docs``, dealt out anew if it has fewer partitions than there are cores: a small table in one large row group
    would be tokenised by one of them."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def build_index(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> Index:
    """Tokenise ``docs`` once and write the index below ``folder``.

    Terms are counted by document in one pass and kept as a table; lengths are sums over it, and postings are it sorted
    by ranges of (term, key), so a term that a third of all documents have is spread over ranges of keys.
    """
    spark = docs.sparkSession
    counted(spread(docs.select(key, text)), key, text).write.mode("overwrite").parquet(f"{folder}/counted")
    rows = spark.read.parquet(f"{folder}/counted")
    rows.groupBy(key).agg(F.sum("tf").alias("dl")).write.mode("overwrite").parquet(f"{folder}/lengths")
    sorted_by(rows.filter("term is not null"), "term", key).write.mode("overwrite").parquet(f"{folder}/postings")
    index = Index(spark, folder)
    vocabulary = rows.filter("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    vocabulary.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/vocabulary")
    counts = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/counted")
    counts.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(counts, True)
    return index


def one_of(column: Column, values: list[str], most: int = 500) -> Column:
    """Whether ``column`` is one of ``values``, by tens up to ``most``: a Parquet scan looks for each of up to ten values in
    its statistics, but only for the range of more."""
    if not 10 < len(values) <= most:
        return column.isin(values)
    return reduce(lambda a, b: a | b, (column.isin(values[i : i + 10]) for i in range(0, len(values), 10)))


def term_trigrams(term: str) -> list[str]:
    padded = f"  {term}  "
    return list(dict.fromkeys(padded[i : i + 3] for i in range(len(term) + 2)))


def similar(stored: DataFrame, words: list[str], most: int = 3, least: float = 0.4) -> DataFrame:
    """(word, term, weight): the ``most`` terms whose trigram sets are nearest to each word's, of at least ``least``.

    ``stored`` has (trigram, term, n: the term's number of trigrams). Its scan is filtered by the words' trigrams and by
    the lengths that can reach ``least``; shared trigrams are counted, so no term is cut again.
    """
    spark = stored.sparkSession
    asked = [(w, g, len(grams)) for w in dict.fromkeys(words) for grams in [term_trigrams(w)] for g in grams]
    if not asked:
        return spark.createDataFrame([], "word string, term string, weight double")
    sizes = [m for _, _, m in asked]
    scan = stored.filter(one_of(F.col("trigram"), sorted({g for _, g, _ in asked})) & F.col("n").between(int(min(sizes) * least), int(max(sizes) / least) + 1))
    both = scan.join(F.broadcast(spark.createDataFrame(asked, "word string, trigram string, m int")), "trigram")  # the trigrams of the words asked
    shared = both.groupBy("word", "term", "n", "m").agg(F.count("*").alias("k"))
    near = shared.withColumn("weight", F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).filter(F.col("weight") >= least)
    order = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("weight"), "term"))
    return near.withColumn("r", order).filter(F.col("r") <= most).select("word", "term", "weight")


def resolve(vocabulary: DataFrame, words: list[str], prefix_last: bool = True, most: int = 3, least: float = 0.4, stored: DataFrame | None = None) -> DataFrame:
    """(word, term, weight): a known word stands for itself, an unknown one for similar terms.

    Similarity is that of the terms' trigram sets, from the trigrams ``stored`` with an index (and those are of the same
    vocabulary) or cut from ``vocabulary`` here; candidates come from an equi-join on trigrams, never from all pairs. The
    last word also stands for every term it begins.
    """
    spark = vocabulary.sparkSession
    asked = spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "word string")
    terms = vocabulary.select("term") if stored is not None else vocabulary.select("term").distinct()
    exact = terms.filter(F.col("term").isin(words)).select(F.col("term").alias("word"), "term", F.lit(1.0).alias("weight"))
    if stored is None:
        stored = terms.withColumn("g", trigrams(F.col("term"))).select(F.explode("g").alias("trigram"), "term", F.size("g").alias("n"))
    unknown = asked.join(exact, "word", "left_anti")
    out = exact.unionByName(similar(stored, words, most, least).join(unknown, "word", "left_semi"))
    if prefix_last and words:
        begun = terms.filter(F.col("term").startswith(words[-1])).select(F.lit(words[-1]).alias("word"), "term", F.lit(1.0).alias("weight"))
        out = out.unionByName(begun)
    return out.groupBy("word", "term").agg(F.max("weight").alias("weight"))


def plain(words: list[str], spark: SparkSession) -> DataFrame:
    """(word, term, weight) of words that stand for themselves alone, as the words of a phrase do."""
    return spark.createDataFrame([(w, w, 1.0) for w in dict.fromkeys(words)], "word string, term string, weight double")


def bm25(post: DataFrame, lengths: DataFrame, asked: DataFrame, n_words: int, key: str = "doc_id", most_terms: int = 10_000, every_word: bool = True) -> DataFrame:
    """(key, score) of documents that hold every one of the ``n_words`` words of ``asked`` (word, term, weight), or any.

    Each term counts once, at its best weight; statistics are those of ``post`` and ``lengths``. Up to ``most_terms``
    asked terms are resolved once and become a filter of the scan of ``post``, so a stored index gives only their rows;
    more (a prefix of a letter) are joined instead.
    """
    terms = asked.groupBy("term").agg(F.max("weight").alias("weight"), F.collect_set("word").alias("words"))
    rows = terms.limit(most_terms + 1).collect()
    few = len(rows) <= most_terms
    if few:
        terms = F.broadcast(post.sparkSession.createDataFrame([tuple(r) for r in rows], terms.schema))  # at most most_terms rows
    hits = (post.filter(one_of(F.col("term"), sorted(r["term"] for r in rows))) if few else post).join(terms, "term")
    # one pass over the hits: the number of documents of a term is counted beside them
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df) if few else df, "term").join(lengths, key).crossJoin(F.broadcast(lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))))
    part = bm25_idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))) * F.col("weight")
    sums = scored.withColumn("part", part).groupBy(key).agg(F.sum("part").alias("score"), F.size(F.array_distinct(F.flatten(F.collect_list("words")))).alias("found"))
    return (sums.filter(F.col("found") == n_words) if every_word else sums).select(key, "score")


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def query_segments(query: str) -> list[tuple[str, str]]:
    """("phrase" or "term", text) in order: what stands in quotes, closed or not, and the words between."""
    found = re.findall(r""""([^"]*)"?|'([^']*)'?|([^ \t]+)""", query.strip())
    return [("phrase", (a or b).strip()) if a or b else ("term", c) for a, b, c in found if (a or b).strip() or c]


def search(docs: DataFrame, query: list[str], limit: int = 20, key: str = "doc_id", text: str = "text", phrase: str | None = None, index: Index | None = None, newest: str | None = None, verify: int | None = 200) -> DataFrame:
    """The best ``limit`` documents; a phrase must also occur literally, in any case. ``newest`` names a column of ``docs``
    by which the latest documents lead, whatever their score.

    With an ``index`` nothing is tokenised. Phrases are looked for in the texts of the best ``max(verify, 10 * limit)``
    documents only, or of all that hold the words if ``verify`` is None.
    """
    post, lengths = (index.postings, index.lengths) if index else (postings(docs, key, text), doc_lengths(docs, key, text))
    asked = resolve(index.vocabulary, query, stored=index.trigrams) if index else resolve(post.select("term"), query)
    found = bm25(post, lengths, asked, len(dict.fromkeys(query)), key)
    if phrase:
        found = phrase_verified(found, docs, phrase, limit, key, text, verify)
    if newest:
        return found.join(docs.select(key, F.col(newest).alias("newest")), key).orderBy(F.desc("newest"), F.desc("score"), key).limit(limit)
    return found.orderBy(F.desc("score"), key).limit(limit)


def phrase_verified(found: DataFrame, docs: DataFrame, phrase: str, limit: int, key: str = "doc_id", text: str = "text", most: int | None = 200) -> DataFrame:
    """The rows of ``found`` whose text holds ``phrase`` in any case, of the best ``max(most, 10 * limit)`` (of all if None)."""
    best = F.broadcast(found.orderBy(F.desc("score"), key).limit(max(most, 10 * limit))) if most is not None else found
    return docs.select(key, text).join(best, key).filter(F.lower(F.col(text)).contains(phrase.lower())).select(key, "score")


def upsert(index: DataFrame, changed: DataFrame, key: str = "doc_id") -> DataFrame:
    """``index`` with the rows of changed keys replaced."""
    return index.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed)


def prune(index: DataFrame, present: DataFrame, key: str = "doc_id") -> DataFrame:
    return index.join(present.select(key).distinct(), key, "left_semi")


def stale(sessions: DataFrame, index: DataFrame, key: str = "path", version: str = "mtime") -> DataFrame:
    """Sessions whose version isn't in the index."""
    return sessions.join(index.select(key, version), [key, version], "left_anti")


def unindexed(sessions: DataFrame, index: DataFrame, lengths: DataFrame, key: str = "path", version: str = "mtime") -> DataFrame:
    """Sessions whose version isn't in the metadata index, or that the search index lacks."""
    missing = sessions.join(lengths.select(key), key, "left_anti")
    return stale(sessions, index, key, version).unionByName(missing).distinct()


def rerank_pool(candidates: DataFrame, tfs: DataFrame, weights: DataFrame, key: str = "doc_id", best: int = 150, all_words: int = 50, project: int = 200) -> DataFrame:
    """key of the candidates (key, score, in_project) worth reading for words that stand together: the best by score,
    those whose weakest word is strongest, and those of the project with most of the words.

    ``tfs`` has (key, word, tf), ``weights`` (word, weight) of the words that count.
    """
    first = F.broadcast(candidates.orderBy(F.desc("score"), key).limit(best).select(key))
    rest = candidates.join(first, key, "left_anti")
    each = rest.crossJoin(F.broadcast(weights)).join(tfs, [key, "word"], "left").withColumn("tf", F.coalesce("tf", F.lit(0.0)))  # a row for each word of the query
    sums = each.groupBy(key, "score", "in_project").agg(F.min(F.col("weight") * F.col("tf") / (F.col("tf") + K1)).alias("weakest"), F.sum(F.col("weight") * F.log1p("tf")).alias("total"))
    strong = sums.orderBy(F.desc("weakest"), F.desc("score"), key).limit(all_words).select(key)
    own = sums.filter("in_project").orderBy(F.desc("total"), F.desc("score"), key).limit(project).select(key)
    return first.unionByName(strong).unionByName(own).distinct()


def near_words(texts: DataFrame, words: list[str], weights: list[float], key: str = "doc_id", text: str = "text", gap: int = 24, last_is_prefix: bool = True, most: int = 8 << 20) -> DataFrame:
    """(key, near): how well the words stand together in a text, by its runs of hits at most ``gap`` characters apart.

    A run counts if it holds two different words. The score is the largest share of the words' weight in one run
    times the square root of the number of runs that count. Runs that are the query itself count once; a text that
    searched for the query keeps half. Hits begin and end where a tokenizer would cut; the last word may go on.
    """
    total = sum(weights)
    verbatim = " ".join(words)
    needle = "|".join(f"({re.escape(w)}|{re.escape(w[:1].upper() + w[1:])}|{re.escape(w.upper())})" for w in words)
    edge = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
    searched = re.compile(r"(?:^|[^a-z0-9_-])(?:search|handoff)[\s\\\\\"'`]+$")

    def cut(t: str, i: int) -> bool:
        a, b = t[i - 1 : i], t[i : i + 1]
        return not (a.isascii() and a.isalnum() and b.isascii() and b.isalnum()) or bool(edge.match(t, i)) or b.isupper() and not a.isupper()

    pattern = re.compile(f"(?=({needle}))")

    def score(t: str | None) -> float:
        t = (t or "")[:most]
        runs: list[list] = []
        for m in pattern.finditer(t):
            q = next(i for i in range(len(words)) if m.group(i + 2))
            a, e = m.start(), m.start() + len(m.group(q + 2))
            if not cut(t, a) or not (cut(t, e) or last_is_prefix and q == len(words) - 1):
                continue
            if not runs or a - runs[-1][1] > gap:
                runs.append([a, e, []])
            runs[-1][1] = max(runs[-1][1], e)
            if q not in runs[-1][2]:
                runs[-1][2].append(q)
        counted = copies = ran = 0
        best = 0.0
        for a, e, seq in runs:
            if len(seq) < 2:
                continue
            if verbatim in " ".join(re.sub("[^a-z0-9]+", " ", t[a:e].lower()).split()):
                ran = ran or bool(searched.search(t[max(0, a - 24) : a].lower()))
                copies += 1
                if copies > 1:
                    continue
            counted += 1
            best = max(best, sum(weights[q] for q in seq))
        return best / total * counted**0.5 * (0.5 if ran else 1.0) if total else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([score(t) for t in batch.column(text).to_pylist()], pa.float64())], [key, "near"])

    return texts.select(key, text).mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, near double")


def reranked(candidates: DataFrame, near: DataFrame, key: str = "doc_id", boost: float = 0.25) -> DataFrame:
    """``candidates`` (key, score, in_project) in their final order: near words first, raised in the project, then the
    project, then the score."""
    known = candidates.join(near, key, "left").withColumn("near", F.coalesce("near", F.lit(0.0)) * (1 + boost * F.col("in_project").cast("int")))
    return known.orderBy(F.desc("near"), F.desc("in_project"), F.desc("score"), key)


def highlighted(text: Column, words: list[str], before: str = "[", after: str = "]") -> Column:
    """``text`` with every occurrence of the words, in any case, between marks."""
    return F.regexp_replace(text, "(?i)(" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + ")", f"{before}$1{after}")


def field_score(words: list[str], **fields: Column) -> Column:
    """The sum of each word's best weight over the fields id, tool, source, prompt, project and model; 0 if a word misses all."""
    exact, prefix, inside = {"id": 100, "tool": 60, "source": 35}, {"id": 70, "tool": 45, "source": 35}, {"id": 40, "tool": 30, "source": 20, "project": 15, "model": 15}
    each = []
    for w in words:
        best = [F.lit(0)]
        for name, c in fields.items():
            hit = F.when(c.contains(w), (25 if len(w) >= 3 else 12) if name == "prompt" else inside[name])
            if name in exact:
                hit = F.when(c == w, exact[name]).when(c.startswith(w), prefix[name]).when(c.contains(w), inside[name])
            best.append(F.coalesce(hit, F.lit(0)))
        each.append(F.greatest(*best))
    total = each[0]
    for e in each[1:]:
        total = total + e
    return F.when(F.least(*each, F.lit(1_000)) > 0, total).otherwise(0).cast("long")
