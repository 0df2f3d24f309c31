"""Session set-up and the shared scratch folder for cut lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "replyforge", cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the submitter configures the session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("REPLYFORGE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own: on a cluster a
    machine-local folder would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="replyforge-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
COALESCED = "spark.sql.adaptive.coalescePartitions.enabled"


@contextmanager
def configured(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Queries that run and files that are listed inside see ``value``."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_removed(spark: SparkSession):
    """Queries that run inside remove their shuffle files when they end, not when the driver next collects garbage."""
    return configured(spark, CLEAN_UP, "true")


def folders_listed(spark: SparkSession):
    """Many small folders are listed by a few tasks for each core and not by a task for each folder."""
    return configured(spark, LISTING_TASKS, str(4 * spark.sparkContext.defaultParallelism))


def small_batches(spark: SparkSession):
    """Batches of rows go to Python by 8 MB, not by Spark's 64: each is held there several times, as Arrow, as objects and in work."""
    return configured(spark, BATCH_BYTES, "8m")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, lets several readers
    prune columns, and gives Catalyst real file sizes. Nothing reads the shuffles of
    the write again, so they go with it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Rows of a table in few files dealt out to all cores; a table in many files stays as it is read.

    A file with one row group is one task, however much work its rows are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application.

    Not needed where it is installed on the executors or given with ``--py-files``.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="replyforge-"), package.name), "zip", package.parent, package.name
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
