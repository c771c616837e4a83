import random

import numpy as np

from reviewlode.operators import vectors
from reviewlode.operators.word_vectors import WordVectors


def test_word_vectors_stay_in_tables(spark, monkeypatch):
    """Words used alike get like vectors, learned in several blocks, and the same ones again; the model is a table, as its words may be many."""
    draw, pools = random.Random(5), ([f"a{i}" for i in range(6)], [f"b{i}" for i in range(6)])
    rows = [(i, draw.choices(pools[i % 2], k=12)) for i in range(600)] + [(600, []), (601, None), (602, ["unseen"])]
    df = spark.createDataFrame(rows, "review_id long, tokens array<string>").repartition(3, "review_id")
    monkeypatch.setattr(vectors, "WORDS_PER_TASK", 2_500)
    model = vectors.fit_word_vectors(df, size=8, min_count=2, passes=16)
    assert isinstance(model, WordVectors)
    found = {r.word: np.array(r.vector) for r in model.getVectors().collect()}
    assert sorted(found) == sorted(pools[0] + pools[1])

    def cosine(x, y):
        return float(found[x] @ found[y] / np.linalg.norm(found[x]) / np.linalg.norm(found[y]))

    alike = [cosine(p[i], p[j]) for p in pools for i in range(6) for j in range(i)]
    apart = [cosine(x, y) for x in pools[0] for y in pools[1]]
    assert min(alike) > max(apart)
    means = {r.review_id: r.features.toArray() for r in model.transform(df).collect()}
    assert len(means) == 603 and not any(means[i].any() for i in (600, 601, 602))
    for i, words in rows[:20]:
        assert np.allclose(means[i], sum(found[w] for w in words) / len(words), atol=1e-6)
    again = {r.word: np.array(r.vector) for r in vectors.fit_word_vectors(df, size=8, min_count=2, passes=16).getVectors().collect()}
    assert all(np.array_equal(found[w], again[w]) for w in found)


def test_texts_without_known_words_keep_their_rows(spark):
    """A table of vectors gives every row its mean: keys may repeat or be null, and a whole block may know no word."""
    table = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "token string, vector array<float>")
    rows = [(1, ["a", "b"]), (1, ["a", None]), (None, ["x"]), (2, None), (3, [])]
    model = WordVectors(table, "tokens", "features", 2)
    found = model.transform(spark.createDataFrame(rows, "review_id long, tokens array<string>")).collect()
    means = sorted((str(r.review_id), r.features.toArray().tolist()) for r in found)
    assert means == [("1", [0.5, 0.0]), ("1", [0.5, 0.5]), ("2", [0.0, 0.0]), ("3", [0.0, 0.0]), ("None", [0.0, 0.0])]
    unknown = model.transform(spark.createDataFrame([(9, ["x", "y"])], "review_id long, tokens array<string>")).collect()
    assert [r.features.toArray().tolist() for r in unknown] == [[0.0, 0.0]]
