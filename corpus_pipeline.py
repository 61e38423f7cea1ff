"""From raw documents to token ids: quality, near duplicates, personal data, source mix, encoding.

Each stage takes all that its predecessor kept; ``run`` writes every stage's result
to the shared folder, reads it again and deletes the one before.  Stages with Python
bound the session's Arrow batches, as their results are computed where they are written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from varloom.llm import bpe, jaccard, mixing, pii, quality
from varloom.llm.common import drop_tables, small_batches, table, written
from varloom.llm.queries import KEY, VOCABULARY


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier accepts; it learns from the labels of the documents it is given."""
    small_batches(spark)
    return quality.good_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id.

    SimHash links of five-word shingles, and more candidates from MinHash bands, as SimHash
    alone cannot reach a similarity of 0.8; all are verified on the whole shingle sets.
    """
    small_batches(spark)
    return jaccard.one_of_each(docs)


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms of the same format; no row leaves."""
    return pii.pseudonymised(docs, KEY)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document beside its id and source."""
    small_batches(spark)
    found = bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return found.select("doc_id", "source", "ids")


STAGES = [
    ("quality classifier", good_quality),
    ("near duplicates", without_near_duplicates),
    ("personal data", with_pseudonyms),
    ("source mix", mixed_sources),
    ("token ids", encoded),
]

#: A trained classifier and a hash of shingles are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_tables(spark, before)
        before = [path]
    return docs
