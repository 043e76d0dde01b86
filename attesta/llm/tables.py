"""Shared steps of the corpus operators: reading, keeping results in the shared folder, and running totals without one task."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.session import checkpoint_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def keep(df: DataFrame, what: str) -> DataFrame:
    """Write a result as Parquet to the shared folder and read it again: later reads survive lost executors."""
    path = new_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, records: int = 2_000) -> None:
    """Let the session send texts to Python in batches of at most so many rows: what a task holds beside its block follows it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)


def pack(docs: DataFrame, own: Sequence[str]) -> DataFrame:
    """The columns `own` and all others in one struct `_row`, so that working columns cannot meet columns of the same name."""
    others = [c for c in docs.columns if c not in own]
    return docs.select(*[c for c in docs.columns if c in own], F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(0).alias("none")]).alias("_row"))


def unpack(packed: DataFrame, docs: DataFrame) -> list:
    """The columns of `docs` in their order, out of a packed frame."""
    return [F.col(c) if c in packed.columns and c != "_row" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_total(df: DataFrame, order: Sequence, values: dict[str, str], what: str = "totals") -> DataFrame:
    """Add exclusive running totals over a global order: `values` maps each new column to the long column it sums.

    Rows are range-partitioned on the order and kept; only one sum per partition is totalled in one
    task, so neither the rows nor a hot key meet in one place. Rows that tie in the order get their
    totals in an arbitrary but fixed order, as the kept table holds them.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions(spark), *order).withColumn("_part", F.spark_partition_id())
    kept = keep(ranged, what)
    per_part = kept.groupBy("_part").agg(*[F.sum(v).alias(f"_sum_{k}") for k, v in values.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("_part", *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_base_{k}") for k in values])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = kept.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_in_{k}") for k, v in values.items()])
    joined = summed.join(base, "_part")
    return joined.select(*df.columns, *[(F.col(f"_base_{k}") + F.col(f"_in_{k}")).cast("long").alias(k) for k in values])
