"""A cleaning pipeline for training text: STAGES turn documents into packed token sequences.

Each stage is one operator of tessera.llm with production parameters; what it returns is written as Parquet and read
again as the next one's input. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import packing, quality, secret_scan, simhash, toxicity
from tessera.llm.common import scope, table, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models accept."""
    return toxicity.keep_ordinary(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_representatives(docs, words=5)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by marks."""
    return secret_scan.redact_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_filter),
    ("toxicity", toxicity_filter),
    ("simhash near-dedup", near_dedup),
    ("secret scan", secret_redaction),
    ("best-fit packing", best_fit_packing),
]

#: Trained models and a tokenizer decide here, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with a written table between any two. What a stage wrote for itself is removed once
    its result has been written; the last stage's tables stay, for its result is still to be computed."""
    rows = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        with scope(spark) as made:
            rows = stage(spark, rows, sf_dir)
            if i + 1 < len(STAGES):
                rows = written(rows, "pipeline-" + name.replace(" ", "-"))
                made.pop()
            else:
                made.clear()
    return rows
