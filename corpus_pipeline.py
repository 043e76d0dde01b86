"""The corpus pipeline: quality, near-duplicates, personal data, mixture, tokens.

Each stage reads what the one before it wrote. Stages but the last return the columns of documents.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

import attesta  # noqa: E402
from attesta.llm import bpe, mixture, neardup, pii, quality, tables  # noqa: E402
from attesta.session import name_local_folder  # noqa: E402

cloudpickle.register_pickle_by_value(attesta)

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that importance resampling draws and that are not toxic; the labels beside the documents train both."""
    return quality.apply(docs, tables.read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return neardup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind."""
    return pii.redact(docs)


def target_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents so that sources reach their target weights; a document taken twice is there twice."""
    return mixture.apply(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the number of tokens and the digests of the ids and of the text decoded from them."""
    return bpe.digests(docs, bpe.vocabulary(spark, RANKS), public_tokenizers.PATTERN, docs.columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("target_mixture", target_mixture),
    ("tokens", tokens),
]

#: Hashed n-gram models, sketches and token ids cannot be said in SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, writing and reading the rows between them."""
    name_local_folder(spark)
    tables.bound_batches(spark)
    docs = tables.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = tables.keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
