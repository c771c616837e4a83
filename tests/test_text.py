import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlode.functions import text as X

ZWNJ = "‌"


@pytest.mark.parametrize(
    "function, given_text, expected",
    [
        (X.strip, "\t  ویلا \n", "ویلا"),
        (X.strip, "  x　", "x"),
        (X.to_persian, f"بوم{ZWNJ}گردي كلبه", "بومگردی کلبه"),
        (X.to_arabic, "خیلـــی کوچک", "خيلي كوچك"),
        (X.drop_punct, f"می{ZWNJ}روم، خوب! کِتاب ۱۲ ab_c", "میروم خوب کتاب ۱۲ ab_c"),
        (X.drop_punct, "این محصول عالیه! خیلی دوست داشتم.", "این محصول عالیه خیلی دوست داشتم"),
        (X.drop_punct, "²½x", "²½x"),
        (X.drop_punct, "٣٤", "٣٤"),
        (X.drop_punct, "中文", "中文"),
        (X.drop_punct, "a b", "a b"),
        (X.drop_digits, "اتاق ۱۲ 3 ٤", "اتاق   "),
        (X.drop_latin, "wifi ضعیف", " ضعیف"),
        (X.first_word, " ویلا در شمال", "ویلا"),
        (X.first_word, "  ", None),
        (lambda c: X.last_segment(c, "،"), "تهران، ایران، شیراز ", "شیراز"),
        (X.model_tokens, "کِتاب و خانهٔ ما ab_1", ["تاب", "خانه", "ما", "ab_1"]),
        (X.sequence_tokens, "Good_food, at\tHOME!", ["good", "food", "at", "home"]),
        (X.words, " a  b\n", ["a", "b"]),
        (X.text_or_empty, None, ""),
        (X.default_na, "", "N/A"),
        (X.na_to_null, "nan", None),
        (X.na_to_null, "none", "none"),
        (X.na_to_null, "N/A ", "N/A "),
        (X.normalise, " يك  ٣ ", "یک ۳"),
    ],
)
def test_literal_cases(one, function, given_text, expected):
    assert one(lambda c: function(c.cast("string")), given_text) == expected


def test_topic_cleaning(one):
    text = f"خیلی تمیز، 12 اتاق ۳ wifi خوب و می{ZWNJ}روم!"
    stop = ["خیلی", "خوب", "و"]
    assert one(lambda c: X.clean_topic(c, stop, True, compat=True), text) == "خيلي تميز اتاق ميروم"
    assert one(lambda c: X.clean_topic(c, stop, True), text) == "تميز اتاق ميروم"
    assert one(lambda c: X.clean_topic(c, stop, False), text) == "تمیز اتاق میروم"


def test_stop_words_keep_order_duplicates_and_case(one):
    kept = one(lambda c: X.keep_words(F.split(c, " "), ["a"]), "b a A b a c")
    assert kept == ["b", "A", "b", "c"]


def test_ngrams_and_padding(one):
    grams = lambda low, high: lambda c: X.ngrams(F.split(c, " "), low, high)
    assert one(grams(1, 3), "a b a") == ["a", "b", "a", "a b", "b a", "a b a"]
    assert one(grams(2, 2), "a") == []
    assert one(grams(2, 3), "a b") == ["a b"]
    assert one(lambda: X.pad_left(F.array(F.lit(5), F.lit(6)), 3)) == [0, 5, 6]
    assert one(lambda: X.pad_left(F.array(*map(F.lit, range(1, 6))), 3)) == [3, 4, 5]


def test_predicates(one):
    assert one(lambda c: X.has_min_chars(c, 5), "عالی") is False
    assert one(lambda c: X.has_min_chars(c, 5), "عالیه") is True
    assert one(X.matches, "wifi ضعیف") is True
    assert one(X.matches, "اینترنت ضعیف") is False
    assert one(lambda c: X.has_min_words(c, 3), "خیلی خوب") is False
    assert one(lambda c: X.has_min_words(c, 3), "خیلی خوب بود") is True
    assert one(lambda p: X.to_class(p), 0.5) == 0
    assert one(lambda p: X.to_class(p), 0.51) == 1


def test_keys(one):
    assert one(lambda i: X.page_url(i, "https://example.org/room/", "/"), 7) == "https://example.org/room/7/"
    assert one(X.sheet_key, "هتل", "SAD") == "هتل_SAD"
    assert one(X.cluster_name, 0) == "Cluster 1"
    assert one(lambda: X.params_json({"k": 5, "a": 0.1})) == '{"a":"0.1","k":"5"}'


def test_whitespace_set_is_pythons():
    assert set(X.WS_CHARS) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


alphabet = st.one_of(
    st.sampled_from(list("ab_1۲٣،.! \t\n   ‌ـِکیيك½²\x1c\x85")),
    st.characters(exclude_categories=["Cs"], max_codepoint=0xFFFF),
)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet, max_size=30), min_size=60, max_size=60))
def test_regex_steps_agree_with_python(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(
        "i",
        X.strip(F.col("t")).alias("strip"),
        X.words(F.col("t")).alias("words"),
        X.has_min_words(F.col("t"), 3).alias("three"),
        X.drop_digits(F.col("t")).alias("digits"),
        X.drop_latin(F.col("t")).alias("latin"),
    )
    for row in rows.collect():
        text = texts[row.i]
        assert row.strip == text.strip()
        assert row.words == text.split()
        assert row.three == (len(text.split()) >= 3)
        assert row.digits == re.sub(r"\d+", "", text)
        assert row.latin == re.sub("[A-Za-z]", "", text)
