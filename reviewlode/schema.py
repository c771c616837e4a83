"""Schemas and fixed values shared by every stage."""

from __future__ import annotations

from pyspark.sql import types as T

REVIEWS = T.StructType(
    [
        T.StructField("page", T.LongType()),
        T.StructField("location", T.StringType()),
        T.StructField("room_type", T.StringType()),
        T.StructField("comment", T.StringType()),
    ]
)

LABELLED = T.StructType(
    [T.StructField("comment", T.StringType()), T.StructField("label", T.StringType())]
)

LEXICON = T.StructType(
    [
        T.StructField("token", T.StringType()),
        T.StructField("lemma", T.StringType()),
        T.StructField("upos", T.StringType()),
        T.StructField("freq", T.LongType()),
    ]
)

TOPICS = T.StructType(
    [
        T.StructField("topic_id", T.IntegerType()),
        T.StructField("topic", T.StringType()),
        T.StructField("importance", T.DoubleType()),
    ]
)

REVIEW_KEYS = ["page", "location", "room_type", "comment"]

# Cells a CSV reader with pandas defaults turns into null.
NA_TOKENS = [
    "", "N/A", "NA", "n/a", "null", "NULL", "None", "nan", "NaN", "-nan", "-NaN",
    "<NA>", "#N/A", "#N/A N/A", "#NA", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN",
]

# The text that stands for a field missing on a page.
MISSING = "N/A"

# Accommodation groups and the raw room types they cover.
ROOM_TYPE_GROUPS = {
    "آپارتمان_سوئیت": ["سوئیت", "آپارتمان", "سوییت"],
    "خانه": ["ویلا", "خانه", "روستایی"],
    "اقامتگاه_بومگردی": [
        "بوم گردی", "اقامتگاه", "اقامتگاه سنتی", "مجتمع اقامتگاهی", "مهمانسرا", "مسافرخانه", "کاروانسرا",
    ],
    "هتل": ["هاستل", "هتل"],
    "کلبه": ["کلبه"],
}

# The two sentiment labels.
POSITIVE, NEGATIVE = "HAPPY", "SAD"
