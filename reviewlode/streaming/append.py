"""Incremental page ingestion: each stored page is turned into reviews exactly once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from reviewlode.session import work_dir
from reviewlode.sources.pages import PageRules, extract_reviews

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)


def append_new_pages(
    spark: SparkSession,
    pages_path: str,
    rules: PageRules,
    out_path: str,
    name: str,
    max_files_per_batch: int = 1000,
    progress_path: str | None = None,
) -> StreamingQuery:
    """Read page files that arrived since the last run and append their reviews.

    The query stops when it has caught up. Its progress lives at ``progress_path``, by default in the
    shared work folder under ``name``, and has to outlast the application. The file sink commits each
    batch once, so a retried run adds no row twice.
    """
    pages = (
        spark.readStream.schema(PAGES)
        .option("maxFilesPerTrigger", max_files_per_batch)
        .parquet(pages_path)
    )
    return (
        extract_reviews(pages, rules)
        .writeStream.format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", progress_path or f"{work_dir(spark)}/append-{name}")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
