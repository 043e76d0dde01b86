"""Append only what is new: the candidate pipeline over a stream of documents.

Each micro-batch runs the same batch operator as the full build, anti-joined to what is already stored, so a
replayed batch adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from attesta.operators.mining import append_candidates


def stored_candidates(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Candidates written so far; empty before the first batch."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except Exception as error:  # the path is created by the first batch
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return like.limit(0)


def append_stream(
    documents: DataFrame, sources: DataFrame, out_path: str, checkpoint: str, lexicon: dict[str, list[str]], required: list[str]
) -> StreamingQuery:
    """Start the append over a stream of (source_document_id, title, text); stops when the input is read."""

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        empty = sources.limit(0).select(F.col("id").alias("source_document_id"), F.lit("").alias("evidence_domain"))
        candidates = append_candidates(sources, batch, empty, lexicon, required)
        known = stored_candidates(spark, out_path, candidates).select("source_document_id", "evidence_domain")
        fresh = candidates.join(known, ["source_document_id", "evidence_domain"], "left_anti")
        fresh.select(*candidates.columns).write.mode("append").parquet(out_path)

    return (
        documents.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def document_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
