"""Lookups from raw values to groups, and simple counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlode.functions import text as X
from reviewlode.operators.skew import lookup_join
from reviewlode.schema import ROOM_TYPE_GROUPS


def mapping_table(spark: SparkSession, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """A ``group → values`` dict as a table, in dict order."""
    groups = ROOM_TYPE_GROUPS if groups is None else groups
    rows = [(position, group, list(values)) for position, (group, values) in enumerate(groups.items())]
    return spark.createDataFrame(rows, "position int, group string, values array<string>")


def invert_mapping(mapping: DataFrame) -> DataFrame:
    """``group → values`` to one row per value; the last group wins."""
    return (
        mapping.select("position", "group", F.explode("values").alias("value"))
        .groupBy("value")
        .agg(F.max_by("group", "position").alias("group"))
    )


def map_values(df: DataFrame, column: str, lookup: DataFrame, row_id: str = "review_id") -> DataFrame:
    """Replace ``column`` by its group in ``lookup(value, group)``; unknown values become null."""
    table = lookup.select(F.col("value").alias(column), F.col("group").alias("_group"))
    joined = lookup_join(df, table, column, "left", spread_by=[row_id])
    return joined.withColumn(column, F.col("_group")).select(*df.columns)


def clean_room_type(df: DataFrame, column: str = "room_type") -> DataFrame:
    """Strip the raw type, then unify its letters."""
    return df.withColumn(column, X.to_persian(X.strip(F.col(column))))


def group_room_types(df: DataFrame, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Raw room types to groups; rows with an unknown type stay, with null."""
    lookup = invert_mapping(mapping_table(df.sparkSession, groups))
    return map_values(clean_room_type(df), "room_type", lookup)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, nulls left out, most frequent first."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), column)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, null included."""
    return df.select(column).distinct()
