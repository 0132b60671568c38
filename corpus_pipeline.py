"""The corpus pipeline: each stage takes the documents that the one before kept.

Toxic documents go, one of each group of exact copies and one of each group of near duplicates
stays, the rest is mixed to target weights (a document that the mix draws from twice is there
twice, with the words of each pass), and the mix is encoded.

Defined cases: a null text counts as empty; such documents are not toxic, are copies of each
other, and are never drawn into the mix.  A null source is a source, a null language has the
common threshold.  Repeated rows and ties are settled by the operators' orders, at last by a hash
of the whole row, so that runs agree.  Columns beside those of ``documents`` are passed on by all
stages but the last, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm import bpe, exact_dups, mixing, near_dups, toxicity
from spanveil.llm.common import alone, removed, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the operator does not reject, by the threshold of their language."""
    scored = toxicity.scored(docs, table(spark, sf_dir, "labels"), columns=docs.columns)
    # By place, as the documents may have columns of the same names as the marks; the last is ``rejected``.
    numbered = scored.toDF(*(f"c{k}" for k in range(len(scored.columns))))
    kept = numbered.where(~F.col(numbered.columns[-1])).select(*numbered.columns[: len(docs.columns)])
    return kept.toDF(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dups.without_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.without_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digested(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic), ("exact dedup", without_copies), ("SimHash near-dedup", without_near_copies),
    ("mixing sources to target weights", mixed), ("BPE encoding and decoding", encoded),
]

#: A trained classifier and a tokenizer can't be written in SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table; those of the stages before are removed from the scratch folder."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        before = path
        docs, path = alone(spark, lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            removed(spark, before)
    return docs
