"""How much the sources of a language differ in their words: term-block dense matrices.

Occurrences are counted by (lang, source, term) where texts are read. A language's kept terms are dealt into blocks by a
hash, its sources into blocks likewise, and a task gets one block of terms for one pair of source blocks. There the
counts are a dense int64 tile, sources by terms; all pairs are broadcast against each other, terms are summed, and the
task gives a partial matrix. Partial matrices add up. Each task also keeps the best terms of every source (a heap's
content), and those are merged by source.

A term that none of a tile's sources has adds the same to a pair wherever it stands, so such terms are only counted.
Rates are whole numbers; no step rounds other than by the stated floors.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.common import dealt, stash, table, task_of

#: Kept terms and sources of a block, about; terms broadcast at a time; counts held while texts are read.
TERMS, SOURCES, AT_ONCE, HELD = 4096, 64, 128, 200_000
#: ASCII letters lower-cased, bytes of other characters as they are, all else spaces.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def word_lists(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text in lists of those in about ``size`` bytes, so a long text is never one list."""
    spaced, at = text.translate(TABLE), 0
    while at < len(spaced):
        stop = spaced.find(b" ", at + size)
        stop = len(spaced) if stop < 0 else stop
        yield spaced[at:stop].split()
        at = stop


def counted_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs) partial counts: occurrences and documents; a null term for every group met."""

    def flush(counts: dict, in_docs: dict) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for (lang, source), terms in counts.items():
            have = in_docs[lang, source]
            out[0] += [lang] * (len(terms) + 1)
            out[1] += [source] * (len(terms) + 1)
            out[2] += [None, *terms]
            out[3] += [0, *terms.values()]
            out[4] += [0, *(have[t] for t in terms)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, COUNTED, strict=True)], schema=COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = {}
        in_docs: dict[tuple[str, str], Counter] = {}
        held = 0
        for batch in batches:
            for text, lang, source in zip(batch.column("text"), batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
                key = lang, source
                if key not in counts:
                    counts[key], in_docs[key] = Counter(), Counter()
                    held += 1
                held -= len(counts[key])
                have: set[bytes] = set()
                for words in word_lists(text.as_buffer().to_pybytes()):
                    counts[key].update(words)
                    have.update(words)
                in_docs[key].update(have)
                held += len(counts[key])
                if held > HELD:
                    yield flush(counts, in_docs)
                    counts, in_docs, held = {}, {}, 0
        yield flush(counts, in_docs)

    own = dealt(docs).select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((text, "text"), (lang, "lang"), (source, "source"))))
    return own.mapInArrow(task_of(run), "lang string, source string, term string, n long, docs long")


def rates(n: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(10**9 * (n + 2) / (total + 2 * terms)), by long division in steps that fit int64 up to 9 * 10**15 words."""
    whole = max(1, total + 2 * terms)  # a language without kept terms has no rates
    out, rest = np.divmod(np.asarray(n, np.int64) + 2, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + more
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def tile(rows: pd.DataFrame, best: int) -> pd.DataFrame:
    """The partial pair matrix of a tile, and for a tile on the diagonal the ``best`` terms of each source.

    ``rows`` are of three kinds: a source of either block (source, side, n: its total), the block of terms (n: how many
    it has) and the counts (source, side, term, n, lang_n).
    """
    kinds = rows["kind"].to_numpy()
    groups, cells = rows[kinds == 0], rows[kinds == 2]
    lang, block, diagonal = rows["lang"].iloc[0], rows[kinds == 1].iloc[0], bool((rows["block_a"] == rows["block_b"]).iloc[0])
    n_terms, total, terms = int(block["n"]), int(block["total"]), int(block["terms"])
    names = {side: g["source"].tolist() for side, g in groups.groupby("side")}
    sums = {side: g["n"].tolist() for side, g in groups.groupby("side")}
    columns, seen = np.unique(cells["term"].to_numpy(), return_inverse=True) if len(cells) else (np.zeros(0, object), np.zeros(0, np.int64))
    dense: dict[int, np.ndarray] = {}
    for side, own in names.items():
        place, at = {s: i for i, s in enumerate(own)}, (cells["side"] == side).to_numpy()
        dense[side] = np.zeros((len(own), len(columns)), np.int64)
        dense[side][[place[s] for s in cells["source"][at]], seen[at]] = cells["n"].to_numpy()[at]
    none = {side: np.array([rates(np.zeros(1, np.int64), s, terms)[0] for s in sums[side]], np.int64) for side in names}
    tall = {side: np.array([rates(d, s, terms) for d, s in zip(dense[side], sums[side])], np.int64).reshape(dense[side].shape) for side in names}
    other = 0 if diagonal else 1
    out: list[tuple] = []
    if 0 in names and other in names:
        part = divergence(none[0][:, None], none[other][None]) * (n_terms - len(columns))
        for at in range(0, len(columns), AT_ONCE):
            p, q = tall[0][:, None, at : at + AT_ONCE], tall[other][None, :, at : at + AT_ONCE]
            part += divergence(p, q).sum(axis=2)
        for i, a in enumerate(names[0]):
            for j in range(i + 1 if diagonal else 0, len(names[other])):
                out.append((lang, a, "pair", names[other][j], int(part[i, j])))
    if diagonal and len(columns):
        all_n = np.zeros(len(columns), np.int64)
        all_n[seen] = cells["lang_n"].to_numpy()
        q = rates(all_n, total, terms)
        for i, a in enumerate(names[0]):
            p = tall[0][i]
            good = np.flatnonzero((dense[0][i] > 0) & (p > q))
            f = divergence(p[good], q[good])
            out += [(lang, a, "term", t, -v) for v, t in heapq.nsmallest(best, zip((-f).tolist(), columns[good]))]
    return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value"])


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10, best: int = 10, terms_per_block: int = TERMS, sources_per_block: int = SOURCES) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source is from each other one, and its most telling terms.

    Null texts, languages and sources are empty strings. A language keeps the terms of at least ``least_docs`` of its
    documents; repeated rows count as documents of their own. A source without terms has pairs and no terms, as all
    have where a language keeps none (each pair is 0 then); a language's only source has no pairs. An empty table gives
    an empty result. Equal values are ordered by the UTF-8 bytes of the item.
    """
    partial = counted_terms(docs, text, lang, source).repartition("lang", "term")  # a hot source or language is spread over its terms
    cells = partial.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")  # a row for each source
    cells = cells.withColumns({"lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term), "first": F.row_number().over(of_term.orderBy("source")) == 1})
    cells = stash(cells.filter((F.col("lang_docs") >= least_docs) | F.col("term").isNull()).select("lang", "source", "term", "n", "lang_n", "first"))
    groups = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = cells.filter("first and term is not null").groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("total"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(of_lang, "lang", "left").fillna(0, ["terms", "total"])
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("long")
    langs = stash(langs.select("lang", "terms", "total", blocks("terms", terms_per_block).alias("term_blocks"), blocks("sources", sources_per_block).alias("source_blocks")))
    counts = cells.filter("term is not null").join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("term"), "term_blocks"))
    sized = counts.filter("first").groupBy("lang", "block").agg(F.count("*").alias("n"))
    every = langs.withColumn("block", F.explode(F.sequence(zero, F.col("term_blocks") - 1)))
    # a row goes to every pair of source blocks that its own is in; on the diagonal it has one side
    own, one, two = F.pmod(F.xxhash64("source"), "source_blocks"), F.col("pair.block_a"), F.col("pair.block_b")
    of_source = F.transform(F.sequence(zero, F.col("source_blocks") - 1), lambda o: F.struct(F.least(own, o).alias("block_a"), F.greatest(own, o).alias("block_b"), F.when(own <= o, 0).otherwise(1).alias("side")))
    pairs = F.flatten(F.transform(F.sequence(zero, F.col("source_blocks") - 1), lambda a: F.transform(F.sequence(a, F.col("source_blocks") - 1), lambda b: F.struct(a.alias("block_a"), b.alias("block_b"), F.lit(0).alias("side")))))
    shape = ["lang", "block", one.alias("block_a"), two.alias("block_b"), F.col("pair.side").alias("side"), "kind", "source", "term", "n", "lang_n", "total", "terms"]
    rows = [
        groups.join(langs, "lang").withColumn("block", F.explode(F.sequence(zero, F.col("term_blocks") - 1))).withColumns({"kind": F.lit(0), "term": none, "lang_n": zero, "pair": F.explode(of_source)}),
        every.join(sized, ["lang", "block"], "left").fillna(0, ["n"]).withColumns({"kind": F.lit(1), "source": none, "term": none, "lang_n": zero, "pair": F.explode(pairs)}),
        counts.withColumns({"kind": F.lit(2), "pair": F.explode(of_source)}),
    ]
    tiles = rows[0].select(*shape).unionByName(rows[1].select(*shape)).unionByName(rows[2].select(*shape))
    made = stash(tiles.groupBy("lang", "block", "block_a", "block_b").applyInPandas(lambda t: tile(t, best), "lang string, source string, part string, item string, value long"))
    half = made.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    mirrored = half.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value")
    found = half.unionByName(mirrored).unionByName(made.filter("part = 'term'"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= best))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words from documents
), g as (select distinct lang, source from d
), kept as materialized (select lang, term from (select lang, unnest(list_distinct(words)) as term from d) t group by all having count(*) >= 10
), n as materialized (select lang, source, term, count(*) as n from (select lang, source, unnest(words) as term from d) t join kept using (lang, term) group by all
), v as (select lang, count(*) as v from kept group by lang
), gn as (select g.lang, g.source, coalesce(v.v, 0) as v, coalesce(s.n, 0) as total from g left join v using (lang) left join (select lang, source, sum(n) as n from n group by all) s using (lang, source)
), p as materialized (select gn.lang, gn.source, k.term, coalesce(n.n, 0) as n, cast(1 + (1000000000 * (coalesce(n.n, 0)::hugeint + 2)) // (total + 2 * v) as bigint) as p
  from gn join kept k using (lang) left join n on n.lang = gn.lang and n.source = gn.source and n.term = k.term
), q as (select lang, term, cast(1 + (1000000000 * (n::hugeint + 2)) // (sum(n) over (partition by lang) + 2 * v) as bigint) as q from (select lang, term, sum(n) as n from n group by all) t join v using (lang)
), pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), found as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
    left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all select p.lang, p.source, 'term', p.term, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) from p join q on p.lang = q.lang and p.term = q.term where p.n > 0 and p.p > q.q
), ranked as (select lang, source, part, item, cast(value as bigint) as value, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from found)
select * from ranked where part = 'pair' or rank <= 10"""
