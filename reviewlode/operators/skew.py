"""Joins and orderings that keep working when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlode.session import BROADCAST_BYTES, BROADCAST_ROWS, fits_broadcast, land

# Keys that may hold more than 1/HEAVY of the rows are spread over SALTS tasks each.
HEAVY = 1000
SALTS = 64


def heavy_keys(df: DataFrame, key: str, limit: int = HEAVY) -> DataFrame:
    """The ``limit`` most frequent values of ``key``, so every value above ``1/limit`` of all rows.

    Counts are combined before the shuffle and each task keeps its own top ``limit`` only.
    """
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .count()
        .orderBy(F.desc("count"), key)
        .limit(limit)
        .select(key)
    )


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    *,
    spread_by: list[str],
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """Join to a table with one row per ``key``.

    A right side of proven size is broadcast. Otherwise both sides shuffle on ``(key, salt)``: rows
    of a frequent key get one of ``salts`` values from a hash of ``spread_by`` (columns that tell
    rows apart), and the single matching right row is repeated once per salt. Rows with a null key
    match nothing and are spread the same way.
    """
    if fits_broadcast(right, max_rows, max_bytes):
        return left.join(F.broadcast(right), key, how)
    heavy = F.broadcast(land(heavy_keys(left, key), "heavy").withColumn("is_heavy", F.lit(True)))
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    salted_left = (
        left.join(heavy, key, "left")
        .withColumn("salt", F.when(F.col("is_heavy") | F.col(key).isNull(), spread).otherwise(0))
        .drop("is_heavy")
    )
    every_salt = F.sequence(F.lit(0), F.lit(salts - 1))
    salted_right = (
        right.join(heavy, key, "left")
        .withColumn("salt", F.explode(F.when(F.col("is_heavy"), every_salt).otherwise(F.array(F.lit(0)))))
        .drop("is_heavy")
    )
    return salted_left.join(salted_right, [key, "salt"], how).drop("salt")


def number_rows(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """Number rows from 1 in a total order, without putting them all in one task.

    A range sort gives every task one slice of the order; ``monotonically_increasing_id`` then holds
    (task, position). The slice sizes, one row per task, turn this into global numbers. The sorted
    table is landed first, so both reads see the same slices.
    """
    return number_stored(df.orderBy(*order), name)


def number_stored(df: DataFrame, name: str = "row_number") -> DataFrame:
    """Number rows from 1 as they come, task by task; the rows are stored."""
    task_bits = 33
    placed = land(df.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_task", F.shiftright("_at", task_bits))
    sizes = placed.groupBy("_task").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_task", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    position = F.col("_at") - F.shiftleft(F.col("_task"), task_bits)
    return (
        placed.join(F.broadcast(starts), "_task")
        .withColumn(name, F.col("_start") + position + 1)
        .select(*df.columns, name)
    )
