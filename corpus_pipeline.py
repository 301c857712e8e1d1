"""From raw documents to a tokenised mix: language ID, exact dedup, near-duplicate removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a
DataFrame; all but the last return the columns of ``documents``.  The mix repeats a document as often
as it takes it, so later stages see each copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memlake.llm import exact_dedup, language_id, mixing, ngram_join, sentencepieces
from memlake.llm.common import Scratch, documents, ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language; those without any letter go."""
    ship(spark)
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    ship(spark)
    return exact_dedup.drop_copies(docs, exact_dedup.temporary_index(spark))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of documents linked by five-word shingles at 80 percent stays, that of the smallest id."""
    ship(spark)
    return ngram_join.keep_one(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    ship(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of the mix."""
    ship(spark)
    return sentencepieces.round_trip_digests(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Language ID, near-duplicate components and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
