"""The registered corpus queries and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe, exact_dups, importance, licenses, mixing, near_dups, neighbours, pii, prefix_trie, quality, sharding, token_counts, toxicity,
)
from .common import table


def tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer())


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digested(table(spark, sf_dir, "documents"), tokenizer())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dups.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_sharding": op1_sharding, "op2_token_counts": op2_token_counts, "op3_licenses": op3_licenses,
    "op4_near_dups": op4_near_dups, "op5_pii": op5_pii, "op6_quality": op6_quality,
    "op7_bpe": op7_bpe, "op8_toxicity": op8_toxicity, "op9_exact_dups": op9_exact_dups, "op10_mixing": op10_mixing, "op11_importance": op11_importance,
    "op12_neighbours": op12_neighbours, "op13_prefix_trie": op13_prefix_trie,
}
ORACLES = {
    "op1_sharding": sharding.ORACLE, "op10_mixing": mixing.ORACLE, "op6_quality": quality.ORACLE, "op9_exact_dups": exact_dups.ORACLE,
    "op11_importance": importance.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE,
}
