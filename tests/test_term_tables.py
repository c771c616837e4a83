import random

import numpy as np
import pytest
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import functions as F

from checks import model_checks
from reviewlode.operators import sentiment, vectors
from reviewlode.operators.linear_tables import LinearTable
from reviewlode.operators.term_tables import TermCounter


@pytest.fixture
def small_driver(monkeypatch):
    """A driver that holds no more than three terms."""
    monkeypatch.setattr(vectors, "VOCAB_LIMIT", 3)


def _texts(spark):
    """Texts of 40 words, some empty; keys repeat and one is null."""
    draw = random.Random(3)
    words = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(120):
        good = i % 2
        chosen = draw.choices(words, weights=[1 + (j % 2 == good) * 3 for j in range(40)], k=draw.randint(0, 14))
        rows.append((None if i == 7 else i // 2, " ".join(chosen), ("SAD", "FINE", "HAPPY")[good + (i % 3 == 0)]))
    return rows, spark.createDataFrame(rows, "review_id long, comment string, label string").repartition(3)


def test_counts_over_a_table_of_terms(spark, monkeypatch):
    """More terms than the driver may hold give the same vectors, term by term; before, they were refused."""
    rows = spark.createDataFrame([(1, ["b", "a", "b", "c", "d"]), (1, ["a", "x"]), (None, []), (3, None), (4, ["a", "d"])], "k long, terms array<string>")
    held = vectors.fit_count_vectorizer(rows, min_df=1)
    assert isinstance(held, CountVectorizerModel)
    monkeypatch.setattr(vectors, "VOCAB_LIMIT", 3)
    model = vectors.fit_count_vectorizer(rows, min_df=1)
    assert isinstance(model, TermCounter)
    listed = {r.pos: r.term for r in vectors.listed_terms(spark, model).collect()}
    assert [listed[i] for i in range(5)] == held.vocabulary == ["a", "d", "b", "c", "x"]

    def entries(df):
        return sorted((str(r.k), r.counts.size, r.counts.indices.tolist(), r.counts.values.tolist()) for r in df.collect())

    whole = rows.where("terms IS NOT NULL")
    assert entries(model.transform(whole)) == entries(held.transform(whole))
    assert ("3", 5, [], []) in entries(model.transform(rows))
    with pytest.raises(vectors.VocabularyTooLarge):
        vectors.fit_count_vectorizer(rows, vocab_limit=4)


@pytest.mark.parametrize("labels", [2, 3])
@pytest.mark.parametrize("params", [{"C": 1.0}, {"C": 10.0, "use_idf": False, "min_df": 5, "ngram_range": (1, 2)}])
def test_a_linear_fit_over_a_table_of_terms(spark, monkeypatch, labels, params):
    """The weights are those of Spark's own fit, run to its end, and every row keeps its place."""
    rows, df = _texts(spark)
    df = df.where("label <> 'FINE'") if labels == 2 else df
    own = sentiment.fit_linear(df, params, 1000)
    monkeypatch.setattr(vectors, "VOCAB_LIMIT", 3)
    model = sentiment.fit_linear(df, params, 1000)
    table = model.pipeline.stages[0]
    assert isinstance(table, LinearTable) and model.labels == own.labels
    tfidf, classifier = own.pipeline.stages
    weights = np.asarray(classifier.coefficientMatrix.toArray())
    idf = tfidf.stages[1].getScalingVec().toArray() if params.get("use_idf", True) else np.ones(weights.shape[1])
    found = {r.token: np.array(r.weights) / np.sqrt(r.square) for r in table.table.collect()}
    assert sorted(found) == sorted(tfidf.stages[0].vocabulary)
    ours = np.array([found[t] for t in tfidf.stages[0].vocabulary]).T
    assert np.allclose(ours, weights, atol=2e-3 * np.abs(weights).max()), np.abs(ours - weights).max()
    assert all(np.isclose(r.square, idf[tfidf.stages[0].vocabulary.index(r.token)] ** 2) for r in table.table.collect())
    new = spark.createDataFrame([*((k, t) for k, t, _ in rows), (900, "nothing known"), (901, "")], "review_id long, comment string")
    scored = model.score(new).groupBy("review_id", "comment", "sentiment").count().collect()
    wanted = own.score(new).groupBy("review_id", "comment", "sentiment").count().collect()
    assert sorted(map(str, scored)) == sorted(map(str, wanted))


def test_count_vectors_query_adds_up_a_table(spark, small_driver, tmp_path):
    """The query has a total for every term, though the terms are more than the driver may hold."""
    draw = random.Random(4)
    words = [f"w{i:02}" for i in range(70)]
    texts = [(i, " ".join(draw.choices(words, k=30)), "en", "src1", 90) for i in range(40)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r.term: r.total for r in model_checks.i2_count_vectors(spark, str(tmp_path)).collect()}
    assert len(found) > 3
    split = [t[1].split() for t in texts]
    assert all(total == sum(s.count(term) for s in split) for term, total in found.items() if " " not in term)
