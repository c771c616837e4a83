import sys

import pyarrow as pa
from pyspark.sql import functions as F

from checks import data as D
from reviewlode.functions import text as X
from reviewlode.operators import surface, tokens


def _plain(texts, spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    found = {r.id: r.k or [] for r in rows.select("id", X.tokenise(F.col("t")).alias("k")).collect()}
    return [[(w.sent, w.pos, w.text) for w in found[i]] for i in range(len(texts))]


def _cut(spark, texts):
    got = surface.surface_tokens(pa.array(texts, pa.string()), surface.kinds(spark))
    rows = list(zip(got.sent.tolist(), got.pos.tolist(), got.words.to_pylist()))
    return [rows[a:b] for a, b in zip(got.starts, got.starts[1:])]


def test_cut_texts_as_the_expressions_do(spark, monkeypatch):
    texts = [
        None, "", " ", ".", "a", "..a b.c!?\n d", "می‌شود ok_1, x؟ y", "é́a 𝒳y 😀😀 z", "a‌b\x85c\x1cd　e", "", None,
        "end.", "!start", "a\n\nb", "x" * 50, "١٢٣ ½ ⅷ", "a--b", "-", "\t",
    ]
    plain = _plain(texts, spark)
    assert _cut(spark, texts) == plain
    monkeypatch.setattr(surface, "PIECE", 4)
    assert _cut(spark, texts) == plain
    part = pa.array(["skip me", *texts], pa.string())[1:]
    assert surface.surface_tokens(part, surface.kinds(spark)).words.to_pylist() == [w for t in plain for _, _, w in t]
    assert _cut(spark, []) == [] and _cut(spark, [None]) == [[]]


def test_kinds_are_those_of_the_expressions(spark):
    points = [p for p in [*range(0x3000), *range(0xF000, 0x10400)]]
    rows = spark.createDataFrame([(p, chr(p)) for p in points], "p int, c string")
    word, sign = X.SURFACE_TOKEN.split("|")
    of = F.when(F.col("c").rlike(X.SENTENCE_END), surface.END).when(F.col("c").rlike(word), surface.WORD)
    of = of.when(F.col("c").rlike(sign), surface.SIGN).otherwise(surface.BLANK)
    table = surface.kinds(spark).table()
    kinds = dict(rows.select("p", of.alias("k")).collect())
    assert {p for p in points if kinds[p] != table[p]} == set() and len(table) == sys.maxunicode + 1


def test_counts_by_value(spark):
    rows = [("en", "a b a."), (None, "a"), ("en", "b"), ("fr", None), ("en", "")]
    got = surface.surface_counts(spark.createDataFrame(rows, "lang string, text string"), "lang", "text")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("en", "a", 2), ("en", "b", 2), (None, "a", 1)], key=str)


def test_annotation_shuffles_no_expressions(spark):
    """Words are cut once per pass in tasks, not by a regular expression over every text."""
    texts = spark.createDataFrame([(1, "a b")], "review_id int, comment string")
    lexicon = spark.createDataFrame([("a", "a", "NOUN", 1)], "token string, lemma string, upos string, freq long")
    plan = tokens.annotate(texts, lexicon)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "split(" not in plan


def test_persian_texts_are_made_once(spark, tmp_path):
    """A query over Persian texts maps their letters once, into a stored table that all its steps read."""
    documents = [(1, "en", "Aba aba"), (2, None, None), (None, "fr", "x.")]
    spark.createDataFrame(documents, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    lowered = D.documents_lower(spark, str(tmp_path))
    lexicon, rows = D.lexicon_fa(lowered), D.reviews_fa(spark, str(tmp_path), lowered, labelled=False)
    assert [tuple(r) for r in lexicon.collect()] == [("ابا", "ابا", "ADJ", 2)]
    assert {(r.review_id, r.comment) for r in rows.collect()} == {(1, "ابا ابا"), (2, None), (None, "خ.")}
    for table in (lexicon, rows):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "translate(" not in plan and "lower(" not in plan
