"""Clusters of comments and the words that describe them."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlode.functions import text as X
from reviewlode.operators.vectors import fit_word_vectors
from reviewlode.operators.word_vectors import WordVectors
from reviewlode.session import for_training, land


def embed(
    df: DataFrame,
    tokens: str = "tokens",
    size: int = 128,
    seed: int = 42,
    name: str = "embedding",
    min_count: int = 1,
) -> tuple[DataFrame, WordVectors]:
    """Mean word vector of every text, from vectors learned on the same corpus."""
    model = fit_word_vectors(df, tokens, "_vector", size, min_count, seed)
    vectors = model.transform(df).withColumn(name, vector_to_array("_vector", "float32"))
    return vectors.drop("_vector"), model


def cluster(
    df: DataFrame, vector: str = "embedding", k: int = 6, seed: int = 42, name: str = "cluster"
) -> tuple[DataFrame, KMeansModel]:
    """K-means; every row gets its cluster id. The rows are stored once, as they are read three times."""
    df = land(df, "points")
    points = df.withColumn("_point", array_to_vector(F.col(vector)))
    training = for_training(points.select("_point"), df.count()).persist()
    try:
        model = KMeans(featuresCol="_point", predictionCol=name, k=k, seed=seed).fit(training)
    finally:
        training.unpersist()
    return model.transform(points).drop("_point"), model


def n_clusters(df: DataFrame, column: str = "cluster") -> DataFrame:
    return df.agg(F.countDistinct(column).alias("n_clusters"))


def cluster_word_counts(
    df: DataFrame, column: str = "comment", cluster: str = "cluster", key: str = "review_id"
) -> DataFrame:
    """``cluster, word, count`` with the place where each word is first seen in its cluster."""
    exploded = df.select(cluster, key, X.explode_words(X.words(F.col(column)), "pos", "word"))
    return (
        exploded.filter("word IS NOT NULL")
        .groupBy(cluster, "word")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min(X.place(F.col(key), F.col("pos"))).alias("first_seen"),
        )
    )


def concat_group(
    df: DataFrame,
    column: str = "comment",
    cluster: str = "cluster",
    key: str = "review_id",
    rows_per_chunk: int = 100,
) -> DataFrame:
    """``cluster, chunk, text``: the comments of a cluster in id order, joined by blanks, in chunks.

    A cluster may hold most of the table, so its text is not one value. A chunk covers a range of
    ids, at most ``rows_per_chunk`` comments; reading chunks in order gives the whole text.
    """
    chunk = F.expr(f"`{key}` div {rows_per_chunk}")
    entries = F.array_sort(F.collect_list(F.struct(key, column)))
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(cluster, chunk.alias("chunk"))
        .agg(entries.alias("_entries"))
        .select(
            cluster, "chunk", F.array_join(F.transform("_entries", lambda e: e[column]), " ").alias("text")
        )
    )


def top_words(
    df: DataFrame, n: int = 5, column: str = "comment", cluster: str = "cluster", key: str = "review_id"
) -> DataFrame:
    """``cluster, rank, word, count``: the most frequent words, ties by first appearance.

    The rank filter is applied inside every task before the shuffle, so a task sends at most ``n``
    words per cluster.
    """
    order = Window.partitionBy(cluster).orderBy(F.desc("count"), F.col("first_seen"))
    return (
        cluster_word_counts(df, column, cluster, key)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select(cluster, "rank", "word", "count")
    )


def cluster_topics(
    df: DataFrame, n: int = 5, column: str = "comment", cluster: str = "cluster", key: str = "review_id"
) -> DataFrame:
    """``cluster, name, top_words``: a cluster whose comments have no words keeps an empty list."""
    ranked = (
        top_words(df, n, column, cluster, key)
        .groupBy(cluster)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("_ranked"))
        .select(cluster, F.transform("_ranked", lambda e: e["word"]).alias("top_words"))
    )
    return (
        df.select(cluster)
        .distinct()
        .join(ranked, cluster, "left")
        .select(
            cluster,
            X.cluster_name(F.col(cluster)).alias("name"),
            F.coalesce("top_words", F.array().cast("array<string>")).alias("top_words"),
        )
    )


def order_clusters(topics: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Clusters with most top words first."""
    return topics.orderBy(F.desc(F.size("top_words")), cluster)
