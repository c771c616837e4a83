"""Session helpers: the shared work folder and size checks before a broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side may hold at most this much; larger sides take the salted join.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024

_local_dirs: dict[str, str] = {}
_landed: weakref.WeakSet[DataFrame] = weakref.WeakSet()


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` when the cluster names one.

    Only a local session may fall back to a temporary folder, because no other machine has to see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="reviewlode-")
    return _local_dirs[app]


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers look for this package where the driver has it, or as it was shipped."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def land(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    Tables lie in one folder per application, which can be removed when the application is over.

    Used where a plan is read several times or where a value depends on the physical layout: the
    table survives a lost executor, so every reader sees the same rows.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if partition_by:
        # Rebalancing gives every folder a few files of even size and splits a folder's hot part.
        df.hint("rebalance", *partition_by).write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    else:
        df.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    _landed.add(stored)
    return stored


def landed(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself if :func:`land` has made it, else its stored form."""
    return df if df in _landed else land(df, name)


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """True when ``df`` is proven to hold at most ``max_rows`` rows and ``max_bytes`` of text.

    Every task counts its own part and sends one row; pass a stored or landed table, since the plan
    behind ``df`` runs once for the measurement.
    """
    width = F.lit(16 * len(df.columns))
    for column in df.columns:
        width = width + F.coalesce(F.octet_length(F.col(column).cast("string")), F.lit(0))
    measured = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("long")), F.lit(0)))
    rows, size = measured.first()
    return rows <= max_rows and size <= max_bytes


# Training rows one task should hold: as many cores as there are work while each gets the lower number,
# and beyond that tasks hold the upper number.
LEAST_ROWS, TRAINING_ROWS = 150, 2_000


def for_training(df: DataFrame, n: int, spread: bool = False) -> DataFrame:
    """Merge the partitions of a small training set of ``n`` rows; a large one keeps its own.

    With ``spread`` a set in fewer partitions than it needs is dealt out evenly, for models that make
    a row much wider than it is stored.

    Iterative fits start one job per step, so on little data they cost as much as there are tasks, and on
    more data as the longest task takes.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-n // TRAINING_ROWS), min(cores, -(-n // LEAST_ROWS)))
    if spread and df.rdd.getNumPartitions() < tasks:
        return df.repartition(tasks)
    return df.coalesce(max(1, tasks))
