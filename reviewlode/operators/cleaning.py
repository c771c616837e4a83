"""Row filters and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlode.functions import text as X


def drop_null(df: DataFrame, column: str = "comment") -> DataFrame:
    return df.dropna(subset=[column])


def min_chars(df: DataFrame, column: str = "comment", n: int = 5) -> DataFrame:
    return df.filter(X.has_min_chars(F.col(column), n))


def exclude_pattern(df: DataFrame, column: str = "comment", pattern: str = X.LATIN) -> DataFrame:
    return df.filter(~X.matches(F.col(column), pattern))


def min_words(df: DataFrame, column: str = "comment", n: int = 3) -> DataFrame:
    return df.filter(X.has_min_words(F.col(column), n))


def drop_empty(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) != "")


def clean_comments(df: DataFrame, pattern: str = X.LATIN, min_length: int = 5) -> DataFrame:
    """Comments that are present, long enough and free of ``pattern``; cheap tests come first."""
    return exclude_pattern(min_chars(drop_null(df), n=min_length), pattern=pattern)


def by_sentiment(df: DataFrame, sentiment: str, keep: tuple[str, ...] = ("comment",)) -> DataFrame:
    """Present comments of one sentiment."""
    return df.filter(F.col("sentiment") == sentiment).select(*keep).dropna(subset=["comment"])


def by_group(df: DataFrame, room_type: str, sentiment: str | None = None) -> DataFrame:
    """Present comments of one room group and, when given, one sentiment."""
    wanted = F.col("room_type") == room_type
    if sentiment is not None:
        wanted = wanted & (F.col("sentiment") == sentiment)
    return df.filter(wanted).dropna(subset=["comment"])
