"""Registered queries of the corpus operators and, where SQL can say it, their check."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from attesta.llm import alignment, archives, bpe, fingerprints, manifest, mixture, neardup, pii, quality, repeats, sharding, topk, training_order
from attesta.llm.tables import read


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(read(spark, sf_dir, "documents"))


def op2_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = training_order.write_shards(training_order.byte_tokens(read(spark, sf_dir, "documents")))
    return training_order.described(training_order.read_shards(spark, place))


def op3_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(read(spark, sf_dir, "documents"))


def op4_pii_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


def op5_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents"))


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, ["doc_id"])


def op7_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where("vec_id % 100 = 0"), vectors)


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.read_archives(spark, archives.write_archives(archives.legacy_archives(read(spark, sf_dir, "pages"))))


def op9_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))[0]


def op11_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op12_fragment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = alignment.vocabularies(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.report(read(spark, sf_dir, "documents"), files)


def op13_incremental_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.tampering_report(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_feistel_shards": op2_feistel_shards,
    "op3_recompression": op3_recompression,
    "op4_pii_contexts": op4_pii_contexts,
    "op5_setsketch": op5_setsketch,
    "op6_bpe_transducer": op6_bpe_transducer,
    "op7_max_score": op7_max_score,
    "op8_arc_to_warc": op8_arc_to_warc,
    "op9_fair_queueing": op9_fair_queueing,
    "op10_importance_resampling": op10_importance_resampling,
    "op11_label_propagation": op11_label_propagation,
    "op12_fragment_alignment": op12_fragment_alignment,
    "op13_incremental_witnesses": op13_incremental_witnesses,
    "pipeline": corpus_pipeline.run,
}

CHECKS: dict[str, str] = {"op7_max_score": topk.SQL, "op8_arc_to_warc": archives.SQL, "op9_fair_queueing": mixture.SQL, "op13_incremental_witnesses": manifest.SQL}

if corpus_pipeline.ORACLE_SQL:
    CHECKS["pipeline"] = corpus_pipeline.ORACLE_SQL
