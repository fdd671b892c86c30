"""The corpus pipeline: documents in, a deduplicated, mixed and tokenised training table out.

Each stage works on everything that its predecessor kept; its result is written as Parquet below the shared
checkpoint folder and read again, so a stage's lineage is one table.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrub.llm import bpe, exact_dedup, minhash, mixing, quality
from scrub.llm.common import Scratch
from scrub.llm.queries import vocabulary_path
from scrub.session import read_table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled rows among them, doesn't reject."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that of the smallest doc_id."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays: five-word shingles, similarity of 0.8 or more."""
    return minhash.drop_near_copies(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the token ids of its whole text."""
    return bpe.tokenised(docs, vocabulary_path())


STAGES = [
    ("quality classifier", good),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mix", mix),
    ("bpe", tokens),
]

#: The classifier, the sketches and the hash-shuffled queue have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; the last stage's rows."""
    docs = read_table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
