"""A corpus pipeline: quality rules, toxicity, near-duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import mixing, packing, quality, simhash, toxicity
from weft.llm.common import collected, stash, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    collected(spark)
    return quality.keep_good(docs)


def civil_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    collected(spark)
    return toxicity.keep_civil(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    collected(spark)
    return simhash.keep_first(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    collected(spark)
    return mixing.mixed_corpus(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    collected(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", civil_texts),
    ("simhash near-dedup", one_of_each),
    ("mixing to target weights", mixed_sources),
    ("packing", packed_sequences),
]

#: Rolling hashes, language models, fingerprints and tokenizers aren't SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
