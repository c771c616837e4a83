"""Readers for reviews, labelled text, word lists and page ids."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlode.functions import text as X
from reviewlode.schema import LABELLED, REVIEWS
from reviewlode.session import land


class MissingInput(FileNotFoundError):
    """An input path does not exist."""


def require_path(spark: SparkSession, path: str) -> str:
    """Fail before any work when an input is missing, on whatever file system it lives."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise MissingInput(f"input '{path}' not found") from error
        raise
    return path


def normalise_names(df: DataFrame) -> DataFrame:
    """``Room Type`` → ``room_type``: lower case, blanks to underscores."""
    return df.toDF(*[name.strip().lower().replace(" ", "_") for name in df.columns])


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV with a header, doubled quotes and line breaks inside cells; null spellings become null.

    A ``multi_line`` file is read by one task, so large inputs should be many files, landed once as
    Parquet with :func:`with_review_id`.
    """
    require_path(spark, path)
    raw = normalise_names(
        spark.read.csv(path, header=True, multiLine=multi_line, quote='"', escape='"')
    )
    return raw.select(*[X.na_to_null(F.col(c)).alias(c) for c in raw.columns])


def read_reviews(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Reviews with the declared types; a ``sentiment`` column is kept when the file has one."""
    raw = read_csv(spark, path, multi_line)
    columns = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in REVIEWS]
    if "sentiment" in raw.columns:
        columns.append(F.col("sentiment"))
    return raw.select(*columns)


def with_review_id(df: DataFrame) -> DataFrame:
    """Give every row a ``review_id`` and land the table, so the ids never change afterwards."""
    return land(df.withColumn("review_id", F.monotonically_increasing_id()), "reviews")


def read_labelled(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The training split: ``comment`` and ``label`` only."""
    require_path(spark, path)
    source = read_csv(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path)
    return source.select(*LABELLED.fieldNames())


def read_wordlist(spark: SparkSession, path: str, strip: bool = True) -> DataFrame:
    """One word per line. ``strip`` trims and drops blank lines; otherwise lines stay as they are."""
    require_path(spark, path)
    lines = spark.read.text(path).toDF("word")
    if not strip:
        return lines
    return lines.select(X.strip(F.col("word")).alias("word")).filter("word <> ''")


def page_urls(spark: SparkSession, base: str, start: int, end: int, suffix: str = "") -> DataFrame:
    """Every page id from ``start`` to ``end`` inclusive, with its address."""
    ids = spark.range(start, end + 1).withColumnRenamed("id", "page_id")
    return ids.withColumn("url", X.page_url(F.col("page_id"), base, suffix))
