"""Corpus pipeline: the stages from raw documents to packed sequences."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reviewlode.llm import jaccard_join, mixing, packing, quality_rules, rule_classifier
from reviewlode.session import work_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents outside their language's and source's fences go."""
    return quality_rules.keep_good(docs)


def good_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier, learned from the labelled documents of the folder: rejected documents go."""
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = rule_classifier.train(given, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rule_classifier.keep_good(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates: the document with the smallest id of every component stays."""
    return jaccard_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: rows repeat as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequence and place of every piece of every row."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", good_by_rules),
    ("quality_classifier", good_by_classifier),
    ("ngram_jaccard_join", one_of_each_group),
    ("mixing", mixed),
    ("best_fit_packing", packed),
]

# The model, the sample and the packing have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage's result is stored and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{work_dir(spark)}/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
