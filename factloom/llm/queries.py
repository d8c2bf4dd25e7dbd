"""The queries opN_<name> of this subpackage: each applies its operator to its whole table. SQL has those that DuckDB can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, chat, exact_dedup, importance, lm_scoring, mixing, quality_classifier, quality_rules, repair, secrets, sharding, simhash, substring_dedup
from factloom.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document, encoded and decoded again."""
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition counts, coverages and verdicts of every document."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of all sources takes."""
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document, by a new ledger of blobs."""
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and masked completions of neighbouring conversations, a row for each pair; of pairs too large for that, a row for each turn."""
    return chat.preferences(chat.neighbours_as_pairs(table(spark, sf_dir, "conversations")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and the near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document."""
    return exact_dedup.group_equal(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pseudo-likelihood of every document under a network trained on all of them."""
    return lm_scoring.score_by_own_corpus(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of every document that repeat what an earlier document holds."""
    return substring_dedup.removals(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults, the cheapest repair and its audit of every conversation, after damage."""
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and the slot of every document, each shard with the mixture of sources of the whole."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document in a draw towards the texts of benchmark."""
    ranked = importance.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


QUERIES = {f.__name__: f for f in (op1_bpe, op2_quality_rules, op3_mixing, op4_secrets, op5_preferences, op6_simhash, op7_exact_dedup, op8_lm_scoring, op9_substring_dedup, op10_quality_classifier, op11_repair, op12_sharding, op13_importance)}
SQL = {"op3_mixing": mixing.SQL, "op5_preferences": chat.SQL, "op7_exact_dedup": exact_dedup.SQL, "op11_repair": repair.SQL, "op12_sharding": sharding.SQL, "op13_importance": importance.SQL}
