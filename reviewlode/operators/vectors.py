"""Term weights and vectors.

The table forms (``review_id, term, weight``) have no vocabulary on the driver and take any corpus.
The vector forms feed ``pyspark.ml`` and refuse a vocabulary beyond their limit instead of cutting it; count vectors
and linear fits then take their terms from tables, see :mod:`term_tables`.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, CountVectorizerModel, ElementwiseProduct, HashingTF, Normalizer, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlode.functions import text as X
from reviewlode.operators.skew import lookup_join, number_rows
from reviewlode.operators.term_tables import TermCounter
from reviewlode.operators.tokens import doc_freq, encode_tokens
from reviewlode.operators.word_vectors import WordVectors, train
from reviewlode.session import land

# Largest vocabulary a driver-side model may hold.
VOCAB_LIMIT = 1 << 22


class EmptyVocabulary(ValueError):
    """No term survives the document-frequency limits."""


class VocabularyTooLarge(ValueError):
    """More terms survive than a driver-side vocabulary may hold."""


def with_terms(
    df: DataFrame, column: str, stop: list[str] | None = None, ngram_range: tuple[int, int] = (1, 1)
) -> DataFrame:
    """Add ``terms``: vectoriser tokens without stop words, then n-grams."""
    kept = X.keep_words(X.model_tokens(F.col(column)), stop or [])
    return df.withColumn("terms", X.ngrams(kept, *ngram_range))


def term_counts(df: DataFrame, terms: str = "terms", key: str = "review_id") -> DataFrame:
    """``key, term, n``; texts are placed by key first, so their terms are counted where they are."""
    placed = df.select(key, terms).repartition(key)
    exploded = placed.select(key, F.explode_outer(terms).alias("term"))
    return exploded.filter("term IS NOT NULL").groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def tfidf(
    df: DataFrame,
    terms: str = "terms",
    key: str = "review_id",
    use_idf: bool = True,
    min_df: float = 1,
    max_df: float = 1.0,
) -> DataFrame:
    """``key, term, weight``: ``tf * (ln((1+n)/(1+df)) + 1)``, each text scaled to length 1."""
    n = df.count()
    frequencies = land(doc_freq(df, terms, min_df, max_df, n), "frequencies")
    rows = lookup_join(term_counts(df, terms, key), frequencies, "term", "inner", spread_by=[key])
    idf = F.log(F.lit(1.0 + n) / (F.col("df") + 1)) + 1
    weighted = rows.withColumn("weight", F.col("n") * idf if use_idf else F.col("n").cast("double"))
    # A text's terms are one window group: as many rows as the text has distinct terms.
    norm = F.sqrt(F.expr(f"sum(weight * weight) over (partition by {key})"))
    return weighted.select(key, "term", (F.col("weight") / norm).alias("weight"))


def _vocabulary(df: DataFrame, terms: str, min_df: float, max_df: float) -> tuple[int, DataFrame, int]:
    """Number of texts, the terms within the limits as a stored table, and their number; the corpus is read once."""
    n = df.count()
    vocabulary = land(doc_freq(df, terms, min_df, max_df, n), "vocabulary")
    return n, vocabulary, vocabulary.count()


def _driver_counter(vocabulary: DataFrame, size: int, terms: str, vocab_limit: int) -> CountVectorizerModel:
    """The count vectoriser of a table of terms, whose size is checked.

    Terms are in order of frequency, ties by name, so the order, and with it every seeded fit, is the same on any cluster.
    """
    check_vocab(size, vocab_limit)
    rows = vocabulary.select("term", "df").collect()
    ordered = [row.term for row in sorted(rows, key=lambda row: (-row.df, row.term))]
    return _counter(vocabulary.sparkSession, ordered, terms)


def _counter(spark: SparkSession, vocabulary: list[str], column: str) -> CountVectorizerModel:
    """``CountVectorizerModel.from_vocabulary``, whose calls for every single term take longer than the corpus.

    The terms go to the JVM as one text, unless one of them holds the mark between them.
    """
    mark = "\0"
    joined = mark.join(vocabulary)
    if joined.count(mark) >= len(vocabulary):
        return CountVectorizerModel.from_vocabulary(vocabulary, inputCol=column, outputCol="counts")
    listed = spark._jvm.java.util.regex.Pattern.compile(mark).split(joined, -1)
    model = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", listed)
    return model.setInputCol(column).setOutputCol("counts")._set(vocabSize=len(vocabulary))


def check_vocab(size: int, vocab_limit: int = VOCAB_LIMIT) -> None:
    """Refuse an empty vocabulary, and one beyond the limit."""
    if size == 0:
        raise EmptyVocabulary("no terms remain; adjust min_df or max_df")
    if size > vocab_limit:
        raise VocabularyTooLarge(f"{size} terms; raise min_df or vocab_limit")


def fit_count_vectorizer(
    df: DataFrame,
    terms: str = "terms",
    min_df: float = 1,
    max_df: float = 1.0,
    vocab_limit: int | None = None,
) -> CountVectorizerModel | TermCounter:
    """Count vectors over the terms within both limits, in order of frequency, ties by name.

    More terms than a driver holds stay in a table, unless ``vocab_limit`` is the most that is wanted.
    """
    _, vocabulary, size = _vocabulary(df, terms, min_df, max_df)
    if vocab_limit is not None or size <= VOCAB_LIMIT:
        return _driver_counter(vocabulary, size, terms, VOCAB_LIMIT if vocab_limit is None else vocab_limit)
    numbered = number_rows(vocabulary, [F.desc("df"), F.col("term")], "id")
    table = land(numbered.select(F.col("term").alias("token"), (F.col("id") - 1).cast("int").alias("id")), "vocabulary")
    return TermCounter(table, size, terms, "counts")


def listed_terms(spark: SparkSession, model: CountVectorizerModel | TermCounter) -> DataFrame:
    """``pos, term``: what stands for each place of the model's vectors."""
    if isinstance(model, TermCounter):
        return model.table.select(F.col("id").alias("pos"), F.col("token").alias("term"))
    return spark.createDataFrame(list(enumerate(model.vocabulary)), "pos int, term string")


def fit_tfidf(
    df: DataFrame,
    terms: str = "terms",
    output: str = "features",
    use_idf: bool = True,
    min_df: float = 1,
    max_df: float = 1.0,
    vocab_limit: int | None = None,
) -> PipelineModel:
    """Vector form of :func:`tfidf`, as a fitted pipeline.

    The weights follow from the document frequencies that chose the vocabulary, put into the
    vectoriser's order by one weighted sum over the term table, so the corpus is not read again.
    """
    n, vocabulary, terms_kept = _vocabulary(df, terms, min_df, max_df)
    counter = _driver_counter(vocabulary, terms_kept, terms, VOCAB_LIMIT if vocab_limit is None else vocab_limit)
    if not use_idf:
        return PipelineModel([counter, Normalizer(p=2.0, inputCol="counts", outputCol=output)])
    units = counter.transform(vocabulary.select(F.array("term").alias(terms), "df"))
    frequencies = units.agg(Summarizer.sum(F.col("counts"), F.col("df"))).first()[0].toArray()
    smooth = ElementwiseProduct(
        scalingVec=Vectors.dense(np.log((1 + n) / (1 + frequencies)) + 1),
        inputCol="counts",
        outputCol="_weighted",
    )
    scale = Normalizer(p=2.0, inputCol="_weighted", outputCol=output)
    return PipelineModel([counter, smooth, scale])


def fit_hashed_tfidf(df: DataFrame, features: int, n: int, terms: str = "terms", output: str = "features") -> PipelineModel:
    """As :func:`fit_tfidf`, all terms being hashed into ``features`` columns; ``n`` is the number of rows."""
    if df.where(F.size(terms) > 0).isEmpty():
        raise EmptyVocabulary("no terms")
    hashed = HashingTF(numFeatures=features, inputCol=terms, outputCol="counts")
    frequencies = np.array(IDF(inputCol="counts", outputCol="_weighted").fit(hashed.transform(df)).docFreq)
    smooth = ElementwiseProduct(
        scalingVec=Vectors.dense(np.log((1 + n) / (1 + frequencies)) + 1),
        inputCol="counts",
        outputCol="_weighted",
    )
    # Columns that no term has are left out, so that a tree does not draw them.
    used = VectorSlicer(inputCol="_weighted", outputCol="_used", indices=[int(i) for i in np.flatnonzero(frequencies)])
    return PipelineModel([hashed, smooth, used, Normalizer(p=2.0, inputCol="_used", outputCol=output)])


# Running words of a block that word vectors are learned from, blocks of that size at most, and words of a block beyond them.
WORDS_PER_TASK, MOST_TASKS, MOST_WORDS = 500_000, 64, 2_000_000

# Passes over the corpus, whatever its size.
WORD_PASSES = 8


def fit_word_vectors(
    df: DataFrame,
    tokens: str = "tokens",
    output: str = "features",
    size: int = 128,
    min_count: int = 1,
    seed: int = 42,
    weight_limit: int | None = None,
    passes: int = WORD_PASSES,
) -> WordVectors:
    """Word vectors learned on the corpus in ``passes`` passes; a text's vector is their mean.

    Weights are tables, see :mod:`word_vectors`, so any number of words is taken unless ``weight_limit`` values are the most
    that is wanted. Blocks grow in number with the corpus, each learns from its own texts, and vectors are merged between passes.
    """
    words = df.select(F.explode_outer(tokens).alias("token")).filter("token IS NOT NULL").groupBy("token")
    listed = land(words.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count), "words")
    kept, places = listed.agg(F.count("token"), F.sum("n")).first()
    if kept == 0:
        raise EmptyVocabulary("no words remain; lower min_count")
    if weight_limit is not None and kept * size > weight_limit:
        raise VocabularyTooLarge(f"{kept} words of {size} values; raise min_count")
    vocab = land(number_rows(listed, [F.desc("n"), F.col("token")], "id").withColumn("id", F.col("id").cast("int")), "words")
    numbered = df.select(F.monotonically_increasing_id().alias("_row"), tokens)
    blocks = max(1, min(places // WORDS_PER_TASK, MOST_TASKS), places // MOST_WORDS)
    texts = encode_tokens(numbered, vocab.select("token", "id"), tokens, "_row").withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)))
    texts = land(texts, "word-ids")
    held = texts.select("_block", F.explode("ids").alias("id")).groupBy("_block", "id").agg(F.count(F.lit(1)).alias("n"))
    held = land(held, "words-of-blocks")
    learned = train(texts, held, held.count(), size, passes, seed)
    return WordVectors(land(vocab.join(learned, "id").select("token", "vector"), "word-vectors"), tokens, output, size)


def mean_pool(df: DataFrame, group: str, vector: str = "embedding", name: str = "mean") -> DataFrame:
    """Mean vector per group, combined before the shuffle."""
    return (
        df.select(group, array_to_vector(F.col(vector)).alias("_v"))
        .groupBy(group)
        .agg(Summarizer.mean(F.col("_v")).alias("_m"))
        .select(group, vector_to_array("_m").alias(name))
    )
