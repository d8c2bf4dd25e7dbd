"""From raw documents to token ids: the stages of a training-data pipeline, each one operator of factloom.llm.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. The first four return the columns of documents: rejected documents are
gone, of copies and near copies one is left, and the mix repeats rows. The last
returns ids and digests.

Defined results: a null text counts as empty in every stage; empty texts are
equal, and are one near-duplicate group; a null id is an id like any other, but
ranks last; rows that share an id are told apart by their texts; equal rows are
copies, of which one stays; an empty table passes through as one; columns
besides doc_id, text and source are passed on, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, exact_dedup, mixing, quality_classifier, simhash
from factloom.llm.common import fresh_path, table
from factloom.llm.queries import VOCABULARY


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on the labels, does not reject."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row of the largest doc_id."""
    return exact_dedup.drop_equal(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document of the least doc_id."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, a row for each document that the mix took."""
    return bpe.encode_digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", classify_quality),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_tokens),
]

#: SQL can express neither the classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet below the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_path(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
