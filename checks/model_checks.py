"""Vectors, classifiers, topic models and clusters over the driver tables."""

from __future__ import annotations

from pyspark.ml.stat import Summarizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks import data as D
from checks.registry import check
from reviewlode.functions import text as X
from reviewlode.operators import clusters, sampling, sentiment, topics, vectors
from reviewlode.plans import scoring, themes
from reviewlode.session import land

# Few iterations for single classifiers; searches and topic models run until each fit settles.
ITERATIONS = 30

# --- vectors ---------------------------------------------------------------------------------

_TERMS_SQL = D.REVIEWS_SQL + f""",
terms AS (SELECT review_id, unnest({D.sql_model_tokens('comment')}) AS term FROM reviews
  WHERE sentiment IS NOT NULL),
tf AS (SELECT review_id, term, count(*) AS n FROM terms GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 5),
n_docs AS (SELECT count(*) AS docs FROM reviews WHERE sentiment IS NOT NULL),
weighted AS (SELECT review_id, term, n * (ln((1 + docs) / (1 + df)) + 1) AS w, n FROM tf JOIN df USING (term), n_docs)"""


def _terms(spark, sf_dir):
    return vectors.with_terms(D.labelled(spark, sf_dir), "comment").select("review_id", "terms")


@check(
    "i1_tfidf",
    D.with_sql(_TERMS_SQL)
    + " SELECT review_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY review_id)), 6) AS weight FROM weighted",
)
def i1_tfidf(spark, sf_dir):
    rows = vectors.tfidf(_terms(spark, sf_dir), min_df=5)
    return rows.withColumn("weight", F.round("weight", 6))


@check(
    "i1_tf_only",
    D.with_sql(_TERMS_SQL)
    + " SELECT review_id, term, round(n / sqrt(sum(n * n) OVER (PARTITION BY review_id)), 6) AS weight FROM weighted",
)
def i1_tf_only(spark, sf_dir):
    rows = vectors.tfidf(_terms(spark, sf_dir), use_idf=False, min_df=5)
    return rows.withColumn("weight", F.round("weight", 6))


def _column_sums(df, column, vocabulary):
    """Sum of a vector column, one row per vocabulary term."""
    sums = df.agg(vector_to_array(Summarizer.sum(F.col(column))).alias("s"))
    terms = df.sparkSession.createDataFrame(list(enumerate(vocabulary)), "pos int, term string")
    return sums.select(F.posexplode("s").alias("pos", "value")).join(terms, "pos")


@check(
    "i1_tfidf_vectors",
    D.with_sql(_TERMS_SQL)
    + """ SELECT term, round(sum(weight), 6) AS total FROM (SELECT term,
      w / sqrt(sum(w * w) OVER (PARTITION BY review_id)) AS weight FROM weighted) GROUP BY term""",
)
def i1_tfidf_vectors(spark, sf_dir):
    terms = _terms(spark, sf_dir)
    model = vectors.fit_tfidf(terms, min_df=5)
    rows = _column_sums(model.transform(terms), "features", model.stages[0].vocabulary)
    return rows.select("term", F.round("value", 6).alias("total"))


_GRAMS = D.sql_model_tokens("comment")


@check(
    "i2_count_vectors",
    D.with_sql(D.REVIEWS_SQL, D.stop_sql("reviews", _GRAMS))
    + f""", listed AS (SELECT list(word) AS words FROM stop),
    kept AS (SELECT review_id, list_filter({_GRAMS}, lambda w: NOT list_contains(listed.words, w)) AS w
      FROM reviews, listed),
    grams AS (SELECT review_id, unnest(list_concat(w,
      list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM kept)
    SELECT term, CAST(count(*) AS DOUBLE) AS total FROM grams GROUP BY term
    HAVING count(DISTINCT review_id) >= 10 AND count(DISTINCT review_id) <= 0.5 * (SELECT count(*) FROM reviews)""",
)
def i2_count_vectors(spark, sf_dir):
    rows = D.reviews(spark, sf_dir)
    stop = D.stop_list(rows, X.model_tokens(F.col("comment")))
    terms = land(vectors.with_terms(rows, "comment", stop, (1, 2)).select("terms"), "terms")
    model = vectors.fit_count_vectorizer(terms, min_df=10, max_df=0.5)
    # Entry by entry, as there may be more terms than a task holds.
    found = F.unwrap_udt("counts")
    entries = model.transform(terms).select(F.explode(F.arrays_zip(found["indices"].alias("pos"), found["values"].alias("value"))))
    totals = entries.groupBy(F.col("col.pos").alias("pos")).agg(F.sum("col.value").alias("total"))
    named = vectors.listed_terms(spark, model).join(totals, "pos", "left")
    return named.select("term", F.coalesce("total", F.lit(0.0)).alias("total"))


@check(
    "d11_mean_pool",
    """SELECT cluster, CAST(pos AS INTEGER) AS pos, round(avg(value), 6) AS value FROM (SELECT label AS cluster,
      generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)
    GROUP BY cluster, pos""",
)
def d11_mean_pool(spark, sf_dir):
    rows = D.table(spark, sf_dir, "embeddings").withColumnRenamed("label", "cluster")
    means = vectors.mean_pool(rows, "cluster").select("cluster", F.posexplode("mean").alias("pos", "value"))
    return means.withColumn("value", F.round("value", 6))


# --- labels and metrics ------------------------------------------------------------------------


@check(
    "i7_encode_label",
    D.with_sql(D.REVIEWS_SQL)
    + """ SELECT review_id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS DOUBLE) AS label_id, label AS decoded
    FROM (SELECT review_id, sentiment AS label FROM reviews WHERE sentiment IS NOT NULL)""",
)
def i7_encode_label(spark, sf_dir):
    rows = D.labelled(spark, sf_dir).select("review_id", "label")
    indexer = sentiment.label_indexer(rows)
    return sentiment.decode_label(indexer.transform(rows), list(indexer.labels), "label_id", "decoded")


@check("d12_accuracy", "SELECT round(avg(CAST(quality <> toxic AS DOUBLE)), 9) AS accuracy FROM labels")
def d12_accuracy(spark, sf_dir):
    rows = D.table(spark, sf_dir, "labels").withColumn("prediction", 1 - F.col("toxic"))
    return sentiment.accuracy(rows, "prediction", "quality").select(F.round("accuracy", 9).alias("accuracy"))


@check(
    "d13_best_candidate",
    """SELECT arg_max(params, m) AS params, round(max(m), 9) AS mean_score FROM (SELECT 'label=' || label AS params,
      avg(CAST(embedding[1] AS DOUBLE)) AS m FROM embeddings GROUP BY label)""",
)
def d13_best_candidate(spark, sf_dir):
    scores = D.table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("candidate"),
        F.concat(F.lit("label="), F.col("label").cast("string")).alias("params"),
        F.get("embedding", 0).cast("double").alias("score"),
    )
    return sentiment.best_candidate(scores).withColumn("mean_score", F.round("mean_score", 9))


# --- classifiers -----------------------------------------------------------------------------


def _split(spark, sf_dir):
    return sampling.split(D.labelled(spark, sf_dir))


def _held_out(model, test):
    scored = model.score(test, name="predicted")
    return sentiment.accuracy(scored, "predicted", "label")


@check("i4_logistic_regression")
def i4_logistic_regression(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return _held_out(sentiment.fit_linear(train, {"C": 10.0}, ITERATIONS), test)


@check("i5_random_forest")
def i5_random_forest(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return _held_out(sentiment.fit_forest(train, trees=20, depth=10), test)


@check("i6_feed_forward")
def i6_feed_forward(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return _held_out(sentiment.fit_mlp(train, size=32, hidden=32), test)


@check("i8_big_grid_search")
def i8_big_grid_search(spark, sf_dir):
    """All 270 candidates in five folds."""
    train, _ = _split(spark, sf_dir)
    return sentiment.best_candidate(sentiment.grid_search(train, sentiment.BIG_GRID))


@check("i9_small_grid_search")
def i9_small_grid_search(spark, sf_dir):
    """All 24 candidates in five folds."""
    train, _ = _split(spark, sf_dir)
    return sentiment.grid_search(train, sentiment.SMALL_GRID)


@check("i10_fit_best")
def i10_fit_best(spark, sf_dir):
    _, report = scoring.train_scorer(D.labelled(spark, sf_dir))
    return report


@check("i11_score")
def i11_score(spark, sf_dir):
    model = sentiment.fit_linear(D.labelled(spark, sf_dir), {"C": 10.0}, ITERATIONS)
    return model.score(D.reviews(spark, sf_dir).drop("sentiment")).select("review_id", "sentiment")


@check("c6_keep_rows_with_predictions")
def c6_keep_rows_with_predictions(spark, sf_dir):
    """Predictions stay on their rows: the same rows come back, each with one label."""
    model = sentiment.fit_linear(D.labelled(spark, sf_dir), {"C": 10.0}, ITERATIONS)
    scored = model.score(D.labelled(spark, sf_dir), name="predicted")
    return scored.select("review_id", "label", "predicted")


@check("i12_score_texts")
def i12_score_texts(spark, sf_dir):
    """One sentence per language, the shortest of each, scored ad hoc."""
    model = sentiment.fit_linear(D.labelled(spark, sf_dir), {"C": 10.0}, ITERATIONS)
    shortest = F.min_by("text", F.struct("n_chars", "doc_id")).alias("text")
    texts = [r.text for r in D.documents(spark, sf_dir).groupBy("lang").agg(shortest).orderBy("lang").collect()]
    return sentiment.score_texts(spark, texts, model)


# --- topics ----------------------------------------------------------------------------------


def _stop(rows):
    return D.stop_list(rows, X.words(F.col("comment")))


def _labelled_fa(spark, sf_dir):
    """Labelled documents as Persian comments, the lexicon and the stop list."""
    lowered = D.documents_lower(spark, sf_dir)
    rows = D.reviews_fa(spark, sf_dir, lowered)
    return rows, D.lexicon_fa(lowered), _stop(rows)


def _texts(spark, sf_dir, **how):
    """All documents as Persian comments, reduced to cleaned phrases, and the stop list."""
    lowered = D.documents_lower(spark, sf_dir)
    rows = D.reviews_fa(spark, sf_dir, lowered, labelled=False)
    stop = _stop(rows)
    return topics.topic_texts(rows, D.lexicon_fa(lowered), stop, **how), stop


def _texts_sql(phrase_sql: str, mapped: bool, keep_empty: bool, min_words: int) -> str:
    """Phrases per review as ``phrase_sql`` (doc_id, p, place), joined, cleaned and without stop words."""
    text, word = ("fa", "word") if not mapped else (D.sql_to_arabic("fa"), D.sql_to_arabic("word"))
    rows = f"rows AS (SELECT * FROM reviews_fa WHERE len({D.sql_words('comment')}) >= {min_words})"
    return (
        D.with_sql(
            D.ALL_FA_SQL,
            D.stop_sql("reviews_fa", D.sql_words("comment")),
            rows,
            D.annotated_sql("rows", "doc_id", "comment", D.LEXICON_FA_SQL),
        )
        + f""", phrases AS ({phrase_sql}),
        joined AS (SELECT r.doc_id, r.room_type, r.sentiment, coalesce(string_agg(p, ' ' ORDER BY place), '') AS fa
          FROM rows r LEFT JOIN phrases p ON p.doc_id = r.doc_id GROUP BY ALL),
        listed AS (SELECT list({word}) AS words FROM stop),
        cleaned AS (SELECT doc_id AS review_id, room_type, array_to_string(list_filter(
            {D.sql_clean_topic_words(text)}, lambda w: NOT list_contains(listed.words, w)), ' ') AS comment, sentiment
          FROM joined, listed)
        SELECT * FROM cleaned {'' if keep_empty else "WHERE comment <> ''"}"""
    )


_RUNS_SQL = """SELECT doc_id, string_agg(lemma, ' ' ORDER BY pos) AS p, min(sent * 1000000 + pos) AS place
  FROM (SELECT *, sum(CASE WHEN upos IN ('NOUN', 'ADJ') THEN 0 ELSE 1 END) OVER
      (PARTITION BY doc_id, sent ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM annotated)
  WHERE upos IN ('NOUN', 'ADJ') GROUP BY doc_id, sent, island HAVING count(*) > 1"""
_PAIRS_SQL = """SELECT doc_id, token || ' ' || next_token AS p, sent * 1000000 + pos AS place FROM (SELECT *,
      lead(token) OVER w AS next_token, lead(upos) OVER w AS next_upos FROM annotated
      WINDOW w AS (PARTITION BY doc_id, sent ORDER BY pos)) WHERE upos = 'NOUN' AND next_upos = 'ADJ'"""
_NOUNS_SQL = "SELECT doc_id, token AS p, sent * 1000000 + pos AS place FROM annotated WHERE upos = 'NOUN'"


@check("i13_topic_texts", _texts_sql(_RUNS_SQL, True, False, 3))
def i13_topic_texts(spark, sf_dir):
    return _texts(spark, sf_dir)[0]


@check("i16_topic_texts", _texts_sql(_PAIRS_SQL, False, True, 0))
def i16_topic_texts(spark, sf_dir):
    return _texts(spark, sf_dir, phrase="pairs", min_words=0, map_letters=False, keep_empty=True)[0]


@check("i20_noun_texts", _texts_sql(_NOUNS_SQL, False, True, 0))
def i20_noun_texts(spark, sf_dir):
    return _texts(spark, sf_dir, phrase="nouns", min_words=0, map_letters=False, keep_empty=True)[0]


@check("i13_fit_topics")
def i13_fit_topics(spark, sf_dir):
    texts, stop = _texts(spark, sf_dir)
    model = topics.fit_topics(texts, k=7, stop=stop)
    return topics.topic_table(spark, model, 4)


def _word_topics(spark, sf_dir):
    """Five topics over the words of all documents."""
    return topics.fit_topics(D.reviews(spark, sf_dir), k=5, ngram_range=(1, 1))


@check("d10_topic_importance")
def d10_topic_importance(spark, sf_dir):
    weights = list(enumerate(topics.topic_importance(_word_topics(spark, sf_dir))))
    return spark.createDataFrame(weights, "topic_id int, importance double")


@check(
    "d10_importance_total",
    D.with_sql(D.REVIEWS_SQL)
    + f""", terms AS (SELECT review_id, unnest({D.sql_model_tokens('comment')}) AS term FROM reviews),
    n AS (SELECT count(*) AS docs FROM reviews),
    kept AS (SELECT term, count(*) AS places FROM terms, n GROUP BY term, docs
      HAVING count(DISTINCT review_id) BETWEEN greatest(2, docs // 50) AND 0.8 * docs)
    SELECT CAST(count(*) AS BIGINT) AS terms, CAST(round(5 * 0.5 * count(*) + sum(places)) AS BIGINT) AS importance FROM kept""",
)
def d10_importance_total(spark, sf_dir):
    """Topic weights are the prior and every place of every term, shared out among the topics."""
    model = _word_topics(spark, sf_dir)
    total = round(sum(topics.topic_importance(model)))
    return spark.createDataFrame([(len(model.ids), total)], "terms long, importance long")


@check("f1_top_terms")
def f1_top_terms(spark, sf_dir):
    terms = topics.top_terms(_word_topics(spark, sf_dir), 4)
    return spark.createDataFrame(list(enumerate(terms)), "topic_id int, terms string")


@check("i14_topics_by_sentiment")
def i14_topics_by_sentiment(spark, sf_dir):
    return themes.sentiment_topics(*_labelled_fa(spark, sf_dir))


@check("i15_topics_by_group")
def i15_topics_by_group(spark, sf_dir):
    return themes.room_topics(*_labelled_fa(spark, sf_dir))


@check("i16_topic_grid")
def i16_topic_grid(spark, sf_dir):
    """The published search, 18 vectorisers, 81 settings and three folds, over the pairs of all documents."""
    texts, stop = _texts(spark, sf_dir, phrase="pairs", min_words=0, map_letters=False, keep_empty=True)
    return topics.topic_grid(texts, stop)[2]


@check("a14_topic_rows")
def a14_topic_rows(spark, sf_dir):
    """The published search per sentiment."""
    return themes.searched_topics(*_labelled_fa(spark, sf_dir), ["HAPPY", "SAD"])


# --- clusters --------------------------------------------------------------------------------


@check("i18_kmeans")
def i18_kmeans(spark, sf_dir):
    rows, _ = clusters.cluster(D.table(spark, sf_dir, "embeddings"), k=6)
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


@check("i19_embed_texts")
def i19_embed_texts(spark, sf_dir):
    rows = D.labelled(spark, sf_dir).select("review_id", X.model_tokens(F.col("comment")).alias("tokens"))
    embedded, _ = clusters.embed(rows, size=16)
    return embedded.select("review_id", F.size("embedding").alias("dimensions"))


@check("i20_cluster_report")
def i20_cluster_report(spark, sf_dir):
    # Every document gets one of the given vectors, in turn.
    given = D.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    ids = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"))
    turn = F.pmod("review_id", F.lit(given.count())).alias("vec_id")
    vectors_table = ids.select("review_id", turn).join(given, "vec_id").select("review_id", "embedding")
    report = themes.cluster_report(
        *_labelled_fa(spark, sf_dir),
        "HAPPY",
        fraction=0.5,
        vectors=vectors_table,
    )
    return report.select("sentiment", "cluster", "name", F.array_join("top_words", " ").alias("top_words"))
