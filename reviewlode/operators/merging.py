"""Combining sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlode.schema import REVIEW_KEYS

# Rows one expansion step may produce from one input row.
EXPAND_STEP = 10_000


def union_all(*frames: DataFrame) -> DataFrame:
    """Bag union by column name."""
    return reduce(DataFrame.unionByName, frames)


def merge_counts(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per key with ``n_rows``, its multiplicity in the full outer join of ``a`` and ``b``.

    The join matches on every column and null equals null, so its result is a function of the two
    key counts: ``a*b`` where both sides have the key, else ``a+b``. Counting combines before the
    single shuffle, so copies of one row never meet in a task.
    """
    keys = keys or REVIEW_KEYS
    tagged = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    counts = tagged.groupBy(*keys).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    both = (F.col("_a") > 0) & (F.col("_b") > 0)
    return counts.select(
        *keys, F.when(both, F.col("_a") * F.col("_b")).otherwise(F.col("_a") + F.col("_b")).alias("n_rows")
    )


def merge_sources(
    a: DataFrame, b: DataFrame, keys: list[str] | None = None, ordered: bool = False
) -> DataFrame:
    """Full outer join on all columns, null-safe, with join multiplicity.

    Rows are repeated from the counts in steps of at most ``EXPAND_STEP``. Keys that need more than
    one step are spread over tasks between the steps; all others are expanded where they are.
    ``ordered`` sorts the result by key.
    """
    keys = keys or REVIEW_KEYS
    counts = merge_counts(a, b, keys)
    small = counts.filter(F.col("n_rows") <= EXPAND_STEP)
    large = counts.filter(F.col("n_rows") > EXPAND_STEP)
    last = F.ceil(F.col("n_rows") / EXPAND_STEP) - 1
    # A given number of tasks: blocks are tiny before they expand, so they must not be merged again.
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = (
        large.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
        .withColumn(
            "n_rows", F.least(F.lit(EXPAND_STEP), F.col("n_rows") - F.col("_block") * EXPAND_STEP)
        )
        .repartition(tasks, *keys, "_block")
        .drop("_block")
    )
    copies = F.explode(F.array_repeat(F.lit(0), F.col("n_rows").cast("int")))
    merged = small.unionByName(blocks).select(*keys, copies.alias("_copy")).drop("_copy")
    return merged.orderBy(*keys) if ordered else merged
