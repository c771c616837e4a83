"""Stored pages to the grouped review table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from reviewlode.functions import text as X
from reviewlode.operators import cleaning, grouping, merging
from reviewlode.sources import pages, readers, sinks


def collect_reviews(pages_one: DataFrame, pages_two: DataFrame) -> DataFrame:
    """Extract both sites' pages and merge them."""
    return merging.merge_sources(
        pages.extract_reviews(pages_two, pages.SITE_TWO), pages.extract_reviews(pages_one, pages.SITE_ONE)
    )


def build_reviews(merged: DataFrame, out_path: str, pattern: str = X.LATIN) -> DataFrame:
    """Clean the merged reviews, give them ids, map room types to groups and write the table."""
    for column in ("location", "room_type"):
        merged = merged.withColumn(column, X.na_to_null(merged[column]))
    cleaned = readers.with_review_id(cleaning.clean_comments(merged, pattern))
    grouped = grouping.group_room_types(cleaned)
    sinks.write_table(grouped, out_path)
    return cleaned.sparkSession.read.parquet(out_path)


def room_report(reviews: DataFrame) -> DataFrame:
    """Reviews per room group, most frequent first."""
    return grouping.value_counts(reviews, "room_type")
