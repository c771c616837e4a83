import math
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reviewlode.functions import text as X
from reviewlode.operators import lemmas, phrases, vectors
from reviewlode.operators import tokens as T


def tagged(spark, *documents):
    """Documents as lists of (sentence, text, tag); the lemma is the text in upper case."""
    rows = [
        (i, [(sent, pos, text, text.upper(), tag) for pos, (sent, text, tag) in enumerate(document)])
        for i, document in enumerate(documents)
    ]
    return spark.createDataFrame(rows, f"review_id long, tokens {T.ANNOTATED}")


DOC_1 = [(0, "a", "NOUN"), (0, "b", "ADJ"), (0, "c", "VERB"), (0, "d", "NOUN")]
DOC_2 = [(0, "e", "ADJ"), (0, "f", "NOUN"), (0, "g", "NOUN")]
SPLIT = [(0, "h", "NOUN"), (1, "i", "ADJ"), (1, "j", "NOUN"), (1, "k", "ADJ")]


def test_phrases(spark):
    rows = tagged(spark, DOC_1, DOC_2, SPLIT, []).select(
        "review_id",
        phrases.noun_adj_pairs(F.col("tokens")).alias("pairs"),
        phrases.noun_adj_tuples(F.col("tokens")).alias("tuples"),
        phrases.noun_adj_runs(F.col("tokens")).alias("runs"),
        phrases.noun_text(F.col("tokens")).alias("nouns"),
    )
    one, two, split, empty = rows.orderBy("review_id").collect()
    assert one.pairs == ["a b"] and [tuple(t) for t in one.tuples] == [("a", "b")] and one.runs == ["A B"]
    assert two.pairs == [] and two.runs == ["E F G"] and two.nouns == "f g"
    assert split.pairs == ["j k"] and split.runs == ["I J K"]
    assert empty.pairs == [] and empty.runs == [] and empty.nouns == ""


LEXICON = [("خوب", "خوب", "ADJ", 5), ("خوب", "خوبی", "NOUN", 2), ("اتاق", "اتاق", "NOUN", 9), ("اتاقها", "اتاق", "NOUN", 1)]


def lexicon(spark):
    return spark.createDataFrame(LEXICON, "token string, lemma string, upos string, freq long")


def test_annotation(spark):
    texts = ["اتاقها خوب، بود. اتاق خوب", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "review_id long, comment string")
    first, blank, missing = T.annotate(rows, lexicon(spark)).orderBy("review_id").collect()
    assert [(t.sent, t.text, t.lemma, t.upos) for t in first.tokens] == [
        (0, "اتاقها", "اتاق", "NOUN"),
        (0, "خوب", "خوب", "ADJ"),
        (0, "،", "،", "X"),
        (0, "بود", "بود", "X"),
        (1, "اتاق", "اتاق", "NOUN"),
        (1, "خوب", "خوب", "ADJ"),
    ]
    assert blank.tokens == [] and missing.tokens == []


def test_own_tagger(spark):
    def tagger(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [(0, i, w, w.lower(), "NOUN") for i, w in enumerate(t.split())])

    rows = spark.createDataFrame([(1, "A b"), (2, "")], "review_id long, comment string")
    first, second = T.annotate_with(rows, tagger).orderBy("review_id").collect()
    assert [tuple(t) for t in first.tokens] == [(0, 0, "A", "a", "NOUN"), (0, 1, "b", "b", "NOUN")]
    assert second.tokens == []


def test_lemma_clean(spark):
    rows = spark.createDataFrame([(1, "اتاقها، خوب!")], "review_id long, comment string")
    assert T.clean_lemma(rows, lexicon(spark)).first().comment == "اتاق خوب"


@pytest.mark.parametrize("limit", [T.STOP_LITERALS, 0])
def test_stop_words_by_set_and_by_join(spark, limit):
    rows = spark.createDataFrame(
        [(1, "x", ["b", "a", "b", "c"]), (2, "y", ["a"]), (3, "z", [])], "review_id long, o string, words array<string>"
    )
    stop = spark.createDataFrame([("a",), ("a",), ("c",)], "word string")
    kept = T.remove_words(rows, "words", stop, limit=limit).orderBy("review_id").collect()
    assert [(r.o, r.words) for r in kept] == [("x", ["b", "b"]), ("y", []), ("z", [])]


def test_long_word_lists_are_refused_by_the_set(spark):
    with pytest.raises(ValueError, match="more than 1"):
        T.word_list(spark.createDataFrame([("a",), ("b",)], "word string"), 1)


def test_vocabulary_and_ids(spark):
    rows = spark.createDataFrame([(1, ["z", "y", "z"]), (2, ["x", "y", "q"]), (3, [])], "review_id long, tokens array<string>")
    vocab = T.build_vocab(rows)
    assert [(r.token, r.id) for r in vocab.orderBy("id").collect()] == [("z", 1), ("y", 2), ("x", 3), ("q", 4)]
    encoded = T.encode_tokens(rows, vocab.filter("id <= 3"))
    assert T.max_len(encoded).first().max_len == 3
    padded = T.pad_sequences(encoded).orderBy("review_id").collect()
    assert [r.ids for r in padded] == [[1, 2, 1], [0, 3, 2], [0, 0, 0]]


def test_document_frequencies(spark):
    rows = spark.createDataFrame([(["a", "a", "b"],), (["a"],), (["a", "c"],), (["b"],)], "tokens array<string>")
    bounds = lambda *b: {(r.term, r.df) for r in T.doc_freq(rows, "tokens", *b).collect()}
    assert bounds(1, 1.0) == {("a", 3), ("b", 2), ("c", 1)}
    assert bounds(2, 0.75) == {("a", 3), ("b", 2)}
    assert bounds(1, 0.5) == {("b", 2), ("c", 1)}
    assert bounds(0.5, 3) == {("a", 3), ("b", 2)}
    assert T.dynamic_min_df(rows).first().min_df == 2
    assert T.dynamic_min_df(rows.sparkSession.range(250)).first().min_df == 5


TEXTS = ["ab cd ab", "cd ef", "ab", "gh gh gh ab"]


def expected_tfidf(use_idf):
    docs = [Counter(t.split()) for t in TEXTS]
    df = Counter(w for d in docs for w in d)
    weights = {}
    for i, d in enumerate(docs):
        raw = {w: n * (math.log((1 + len(docs)) / (1 + df[w])) + 1 if use_idf else 1) for w, n in d.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        weights |= {(i, w): v / norm for w, v in raw.items()}
    return weights


@pytest.mark.parametrize("use_idf", [True, False])
def test_tfidf_forms_agree(spark, use_idf):
    rows = vectors.with_terms(
        spark.createDataFrame(list(enumerate(TEXTS)), "review_id long, comment string"), "comment"
    )
    want = expected_tfidf(use_idf)
    table = {(r.review_id, r.term): r.weight for r in vectors.tfidf(rows, use_idf=use_idf).collect()}
    assert table.keys() == want.keys() and all(abs(table[k] - want[k]) < 1e-12 for k in want)
    model = vectors.fit_tfidf(rows, use_idf=use_idf)
    vocabulary = model.stages[0].vocabulary
    for row in model.transform(rows).collect():
        for index, value in zip(row.features.indices, row.features.values):
            assert abs(value - want[row.review_id, vocabulary[index]]) < 1e-12


def test_vocabulary_limits(spark):
    rows = spark.createDataFrame([(["a", "b"],), (["a"],)], "terms array<string>")
    assert sorted(vectors.fit_count_vectorizer(rows).vocabulary) == ["a", "b"]
    assert vectors.fit_count_vectorizer(rows, max_df=0.5).vocabulary == ["b"]
    assert vectors.fit_count_vectorizer(rows, max_df=1).vocabulary == ["b"]
    assert vectors.fit_count_vectorizer(rows, max_df=0.5, vocab_limit=1).vocabulary == ["b"]
    with pytest.raises(vectors.EmptyVocabulary):
        vectors.fit_count_vectorizer(rows, min_df=2, max_df=0.5)
    with pytest.raises(vectors.EmptyVocabulary):
        vectors.fit_count_vectorizer(rows, min_df=3)
    with pytest.raises(vectors.VocabularyTooLarge):
        vectors.fit_count_vectorizer(rows, vocab_limit=1)


def test_word_vectors_are_bounded(spark):
    rows = spark.createDataFrame([(["a", "b"],), (["a"],)], "tokens array<string>")
    assert vectors.fit_word_vectors(rows, size=4, min_count=2).getVectors().count() == 1
    with pytest.raises(vectors.VocabularyTooLarge):
        vectors.fit_word_vectors(rows, size=4, weight_limit=7)
    with pytest.raises(vectors.EmptyVocabulary):
        vectors.fit_word_vectors(rows, size=4, min_count=3)


def test_mean_pool(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0]), (1, [5.0, 6.0])], "c int, embedding array<float>")
    assert {r.c: r["mean"] for r in vectors.mean_pool(rows, "c").collect()} == {0: [2.0, 3.0], 1: [5.0, 6.0]}


def test_explosion_does_not_repeat_the_array_expression(spark):
    rows = spark.range(3).select(
        F.col("id").alias("review_id"), X.words(F.col("id").cast("string")).alias("tokens")
    )
    plan = T.token_counts(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_unseen_words_get_lemmas_by_their_endings(spark):
    known = [("walking", "walk", "VERB"), ("talking", "talk", "VERB"), ("houses", "house", "NOUN"), ("cars", "car", "NOUN")]
    known += [("ring", "ring", "NOUN"), ("cities", "city", "NOUN"), ("parties", "party", "NOUN"), ("went", "go", "VERB"), ("a", "a", "DET")]
    entries = spark.createDataFrame([(*k, 5) for k in known] + [(None, "x", "X", 1), ("y", None, None, 1)], "token string, lemma string, upos string, freq long")
    rules = {r.ending: (r.cut, r.added, r.upos, r.words, r.total) for r in lemmas.ending_rules(entries).collect()}
    assert rules["ing"] == (3, "", "VERB", 2, 3) and rules["s"] == (1, "", "NOUN", 2, 2) and rules["ies"] == (3, "y", "NOUN", 2, 2)
    assert "rs" not in rules and "went" not in rules  # one word only, and no ending that holds the whole cut
    texts = spark.createDataFrame([(1, "singing ladies, cars walking 12 zzz s")], "review_id long, comment string")
    full = lemmas.with_guesses(texts, entries)
    got = {r.token: (r.lemma, r.upos) for r in full.where("freq = 0").collect()}
    assert got == {"singing": ("sing", "VERB"), "ladies": ("lady", "NOUN")}
    tagged = T.annotate(texts, full).first().tokens
    assert [t.lemma for t in tagged if t.upos != "X"] == ["sing", "lady", "car", "walk"]
    assert lemmas.guess(texts.select(F.lit("x").alias("token")).limit(0), lemmas.ending_rules(entries)).count() == 0


def test_held_out_words_get_their_lemma(spark):
    """Regular words, a third of them held out: all endings are covered, so every lemma and tag comes back."""
    rows = [(f"{stem}{a}{ending}", f"{stem}{a}{base}", tag) for stem in ("tal", "mor", "bin", "kur") for a in "abcdefg" for ending, base, tag in (("ten", "t", "VERB"), ("nisse", "nis", "NOUN"), ("lich", "", "ADJ"))]
    known = spark.createDataFrame([(*r, 1) for i, r in enumerate(rows) if i % 3 != i // 3 % 3], "token string, lemma string, upos string, freq long")
    unseen = [r for i, r in enumerate(rows) if i % 3 == i // 3 % 3]
    words = spark.createDataFrame([(r[0],) for r in unseen], "token string")
    got = {r.token: (r.lemma, r.upos) for r in lemmas.guess(words, lemmas.ending_rules(known)).collect()}
    assert got == {t: (lemma, tag) for t, lemma, tag in unseen}


def test_own_tagger_gets_few_texts_at_a_time(spark, monkeypatch):
    def tagger(texts: pd.Series) -> pd.Series:
        assert list(texts.index) == list(range(len(texts)))
        return texts.map(lambda t: [(0, len(texts), t or "", "", "X")])

    monkeypatch.setattr(T, "TAGGED_CHARS", 10)
    texts = ["a" * 4, None, "b" * 4, "", "c" * 30, "d"]
    rows = spark.createDataFrame(list(enumerate(texts)), "review_id long, comment string").coalesce(1)
    found = {r.review_id: r.tokens[0] for r in T.annotate_with(rows, tagger).collect()}
    assert [found[i].text for i in range(6)] == [t or "" for t in texts]
    assert max(t.pos for t in found.values()) == 4 and found[4].pos <= 2


def test_words_looked_up_block_by_block(spark, monkeypatch):
    """Words do not move one by one, and any number of blocks agrees."""
    texts = ["خوب اتاق!؟ خوب... a?b", None, "", "zz zz", "اتاق"] * 40
    rows = spark.createDataFrame([(None if i % 7 == 0 else i % 50, t) for i, t in enumerate(texts)], "review_id long, comment string")
    entries = lexicon(spark).unionByName(
        spark.createDataFrame([("?", None, "P", 3), ("!؟", "x", None, 1), (None, "n", "N", 9)], lexicon(spark).schema)
    )
    wanted = {
        texts[0]: [
            (0, 0, "خوب", "خوب", "ADJ"), (0, 1, "اتاق", "اتاق", "NOUN"), (1, 0, "خوب", "خوب", "ADJ"), (2, 0, "a", "a", "X"),
            (3, 0, "b", "b", "X"),
        ],
        "zz zz": [(0, 0, "zz", "zz", "X"), (0, 1, "zz", "zz", "X")],
        "اتاق": [(0, 0, "اتاق", "اتاق", "NOUN")],
    }
    expected = sorted((-1 if i % 7 == 0 else i % 50, wanted.get(t, [])) for i, t in enumerate(texts))
    for size in (T.BLOCK_BYTES, 10):
        monkeypatch.setattr(T, "BLOCK_BYTES", size)
        found = T.annotate(rows, entries)
        assert sorted((-1 if r.review_id is None else r.review_id, [tuple(t) for t in r.tokens]) for r in found.collect()) == expected
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroups" in plan and plan.count("Generate") == 1


def test_ids_looked_up_block_by_block(spark, monkeypatch):
    tokens = [["a", "b", None, "a"], [], None, ["q"], ["b", "c"]]
    rows = spark.createDataFrame([(i % 3 or None, t) for i, t in enumerate(tokens)], "review_id long, tokens array<string>")
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("b", 5), ("c", None), (None, 7)], "token string, id long")
    for size in (T.BLOCK_WORDS, 1):
        monkeypatch.setattr(T, "BLOCK_WORDS", size)
        found = T.encode_tokens(rows, vocab)
        assert sorted((r.review_id or 0, r.ids) for r in found.collect()) == [(0, []), (0, [1, 2, 5, 1]), (1, []), (1, [2, 5]), (2, [])]
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroups" in plan and plan.count("Generate") == 1
