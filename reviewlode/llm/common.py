"""Helpers shared by the operators: word rules, stored tables, checked broadcasts, components."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import reviewlode
from reviewlode.session import fits_broadcast, land

WORD = r"[^\x20\x09-\x0D]+"
# Rounds of the component loop before it gives up; each round at least halves long paths.
COMPONENT_ROUNDS = 60


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers look for this package where the driver has it, or as it was shipped."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(reviewlode.__file__)))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with workers that find this package."""
    workers_find_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """Words in order; empty for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def doc_hash(doc_id: Column) -> Column:
    """crc32 of the id as text, the number behind every held-out split."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """``df`` marked for a broadcast if it is measured to be small, else as it is."""
    return F.broadcast(df) if fits_broadcast(df, max_rows=max_rows, max_bytes=16 * 1024 * 1024) else df


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove stored tables that no plan reads any more, and let go of finished shuffles.

    Spark removes shuffle files when the driver collects the plans that made them, which a driver with
    little to do may put off for long.
    """
    for stored in tables:
        for file in stored.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    gc.collect()
    spark._jvm.System.gc()


def free(names: list[str], name: str) -> str:
    """``name``, with underscores added until it clashes with none of ``names``."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v: long) as (node, root) of every node but the root.

    The root is a component's smallest node.

    Alternates the large-star and small-star steps; each needs one minimum per node, which combines
    before the shuffle, and one join, whose hot nodes adaptive execution splits. Every round is a
    stored table, so a lost executor costs one round. Nodes without an edge are not returned.
    """
    edges = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    edges = land(edges.distinct(), "edges")
    for _ in range(COMPONENT_ROUNDS):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        # Larger neighbours of a node go to the smallest node around it.
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").distinct()
        large = land(large, "edges")
        # Smaller neighbours of a node, and the node, go to the smallest of them.
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = large.join(low, "v").where("u <> m").select("m", "u")
        edges = land(moved.union(low.select("m", "v")).distinct().toDF("u", "v"), "edges")
        # Done when every edge is one of a star: no node has two centres, and no centre has one.
        places = edges.select("v", F.lit(1).alias("n")).union(edges.select("u", F.lit(0)).distinct())
        if places.groupBy("v").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).where("n > 0 and k > 1").isEmpty():
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    raise RuntimeError("components did not settle")
