"""Session defaults for local runs and for the cluster."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


# Spark's own targets (64 MB of a shuffle, compressed; 128 MB of a file) came to 1.2 GB of sorts and hash tables in one task of the release view.
TASK_BOUNDS = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
    "spark.sql.files.maxPartitionBytes": "32m",
}


def build_session(app: str = "attesta", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators rely on.

    On a cluster only the portable settings are applied: master, memory and shuffle parallelism come
    from the submit command, and AQE sizes the shuffles at run time.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
            .config("spark.driver.memory", "12g")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        )
    return builder.getOrCreate()


def bound_tasks(spark: SparkSession) -> None:
    """Where the session names no sizes: cut files and shuffles fine and join pieces up to a fixed size, so a task's share does not grow with the input."""
    for key, value in TASK_BOUNDS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def name_local_folder(spark: SparkSession) -> None:
    """Give a local session that names no shared folder one of its own; a cluster must name a shared one itself."""
    if spark.sparkContext.getCheckpointDir() is None and spark.sparkContext.master.split("[")[0] == "local":
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; without it nothing is kept."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition rows with costly per-row work by their key, at every size alike."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def materialize(df: DataFrame) -> DataFrame:
    """Compute a result that several branches read once, and keep it in the shared checkpoint folder.

    For reduced results only (matches, decisions): the stored copy survives the loss of executors.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Like `materialize`, as Parquet: Spark then knows the size and sends small tables to every task instead of shuffling large ones."""
    path = f"{checkpoint_dir(df.sparkSession)}/kept-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
