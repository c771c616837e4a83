"""Review-shaped views over the driver tables, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlode.functions import text as X
from reviewlode.operators.surface import surface_counts
from reviewlode.operators.tokens import word_list
from reviewlode.session import land

# Raw room types by source, with the flaws real pages show: outer blanks, Arabic letters, joiners.
RAW_TYPES = [
    "ويلا", "\tآپارتمان ", "سوئیت", "خانه", " بوم گردي", "كلبه", "سوییت", "اقامتگاه", "اقامتگاه سنتی",
    "هتل\n", "مجتمع اقامتگاهي", "مهمانسرا", "هاستل", "مسافرخانه", "روستا‌یی", "كاروانسرا",
    "بوم‌گردی", "N/A", "", "چادر",
]
ROOM_CASE = (
    "CASE d.source "
    + " ".join(f"WHEN 'src{i}' THEN '{t}'" for i, t in enumerate(RAW_TYPES))
    + " END"
)

# The tables hold European text: its letters are mapped to Persian and Arabic ones, to signs that
# cleaning removes and to digits, so the Persian rules have something to act on in every row.
LATIN = "abcdefghijklmnopqrstuvwxyzéèêç"
PERSIAN = "ابچدعفگهیجكلمنوپقرستيکـخ‌زِ٤۱²"

DOCUMENT_SQL = f"""
documents_fa AS (SELECT *, translate(text, '{LATIN}', '{PERSIAN}') AS fa FROM documents)"""

REVIEWS_SQL = f"""
reviews AS (
  SELECT d.doc_id AS review_id, d.doc_id AS page,
         CASE WHEN d.lang = 'es' THEN 'N/A' ELSE d.lang END AS location,
         {ROOM_CASE} AS room_type, d.text AS comment,
         CASE l.quality WHEN 1 THEN 'HAPPY' WHEN 0 THEN 'SAD' END AS sentiment
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a table whose files give fewer tasks than there are cores; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(table(spark, sf_dir, "documents"), "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(table(spark, sf_dir, "pages"), "page_id")


def persian(c: Column) -> Column:
    return F.translate(c, LATIN, PERSIAN)


def documents_fa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``review_id, fa``: every text in Persian letters."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("review_id"), persian(F.col("text")).alias("fa")
    )


def documents_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, text``: lower case in Persian letters, stored once for queries that read it several times."""
    rows = documents(spark, sf_dir).select("doc_id", "lang", persian(F.lower("text")).alias("text"))
    return land(rows, "documents-lower")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (
        documents(spark, sf_dir)
        .alias("d")
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("review_id"),
            F.col("doc_id").alias("page"),
            F.when(F.col("lang") == "es", "N/A").otherwise(F.col("lang")).alias("location"),
            F.expr(ROOM_CASE).alias("room_type"),
            F.col("text").alias("comment"),
            F.expr("CASE quality WHEN 1 THEN 'HAPPY' WHEN 0 THEN 'SAD' END").alias("sentiment"),
        )
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``review_id, comment, label`` of the labelled documents."""
    rows = reviews(spark, sf_dir).filter("sentiment IS NOT NULL")
    return rows.select("review_id", "comment", F.col("sentiment").alias("label"))


# --- words -----------------------------------------------------------------------------------

WORD = rf"[^{X.WS}]+"
TOP_STOP = 50


def stop_words(df: DataFrame, words: Column) -> DataFrame:
    """The most frequent words as a stop list."""
    exploded = df.select(F.explode_outer(words).alias("word")).filter("word IS NOT NULL")
    counts = exploded.groupBy("word").count()
    return counts.orderBy(F.desc("count"), "word").limit(TOP_STOP).select("word")


def stop_list(df: DataFrame, words: Column) -> list[str]:
    return word_list(stop_words(df, words))


def stop_sql(source: str, words: str) -> str:
    return f"""
stop AS (SELECT word FROM (SELECT unnest({words}) AS word FROM {source})
         GROUP BY word ORDER BY count(*) DESC, word LIMIT {TOP_STOP})"""


# --- lexicon ---------------------------------------------------------------------------------

TAG_SQL = """CASE WHEN right(lower(token), 1) IN ('a', 'e', 'i', 'o', 'u', 'é') THEN 'ADJ'
  WHEN right(lower(token), 1) IN ('n', 't', 's', 'r', 'h') THEN 'NOUN'
  WHEN lang = 'en' AND right(lower(token), 1) IN ('y', 'd') THEN 'ADJ' ELSE 'VERB' END"""
LEMMA_SQL = "CASE WHEN lang = 'en' THEN regexp_replace(lower(token), 's$', '') ELSE lower(token) END"


FA_TAG_SQL = "CASE length(token) % 3 WHEN 0 THEN 'ADJ' WHEN 1 THEN 'NOUN' ELSE 'VERB' END"
FA_LEMMA_SQL = f"replace(token, '{X.TATWEEL}', '')"


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test double for a dictionary: every word seen twice in a language, tagged by its last letter."""
    return _lexicon(documents(spark, sf_dir).select("lang", "text"), LEMMA_SQL, TAG_SQL)


def lexicon_fa(lowered: DataFrame) -> DataFrame:
    """The same over the Persian texts of :func:`documents_lower`, tagged by word length."""
    return _lexicon(lowered, FA_LEMMA_SQL, FA_TAG_SQL)


def _lexicon(texts: DataFrame, lemma: str, tag: str) -> DataFrame:
    counts = surface_counts(texts, "lang", "text").withColumnRenamed("n", "freq").filter("freq >= 2")
    words = counts.filter(F.col("token").rlike(r"\A\p{L}"))
    return words.select("token", F.expr(lemma).alias("lemma"), F.expr(tag).alias("upos"), "freq")


def reviews_fa(spark: SparkSession, sf_dir: str, lowered: DataFrame, labelled: bool = True) -> DataFrame:
    """``review_id, room_type, comment, sentiment``: Persian comments of :func:`documents_lower`, the language as room type.

    Unless only ``labelled`` ones are asked for, all documents are there, some without a sentiment.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return lowered.join(labels, "doc_id", "inner" if labelled else "left").select(
        F.col("doc_id").alias("review_id"),
        F.col("lang").alias("room_type"),
        F.col("text").alias("comment"),
        F.expr("CASE quality WHEN 1 THEN 'HAPPY' WHEN 0 THEN 'SAD' END").alias("sentiment"),
    )


REVIEWS_FA_SQL = f"""
documents_lower AS (SELECT doc_id, lang, translate(lower(text), '{LATIN}', '{PERSIAN}') AS text FROM documents),
reviews_fa AS (SELECT d.doc_id, d.lang AS room_type, d.text AS comment,
    CASE quality WHEN 1 THEN 'HAPPY' WHEN 0 THEN 'SAD' END AS sentiment
  FROM documents_lower d JOIN labels l ON l.doc_id = d.doc_id)"""
ALL_FA_SQL = REVIEWS_FA_SQL.replace("JOIN labels", "LEFT JOIN labels")


def tokens_sql(source: str, key: str, column: str, name: str = "toks", carry: str = "") -> str:
    """Sentence and token positions of ``column``."""
    extra = f", {carry}" if carry else ""
    return f"""
{name}_sents AS (SELECT {key}{extra}, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sent
  FROM (SELECT {key}{extra}, string_split_regex({column}, '{X.SENTENCE_END}') AS s FROM {source})),
{name} AS (SELECT {key}{extra}, sent, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos
  FROM (SELECT {key}{extra}, sent, regexp_extract_all(sentence, '{X.SURFACE_TOKEN}') AS t FROM {name}_sents))"""


def lexicon_sql(source: str, lemma: str, tag: str) -> str:
    return (
        tokens_sql(source, "doc_id", "text", "lex", "lang")
        + f""",
lexicon AS (SELECT token, {lemma} AS lemma, {tag} AS upos, freq
  FROM (SELECT lang, token, count(*) AS freq FROM lex GROUP BY lang, token)
  WHERE freq >= 2 AND regexp_matches(token, '^\\p{{L}}')),
best AS (SELECT * FROM lexicon QUALIFY
  row_number() OVER (PARTITION BY token ORDER BY freq DESC, lemma DESC, upos DESC) = 1)"""
    )


LEXICON_SQL = lexicon_sql("documents", LEMMA_SQL, TAG_SQL)
LEXICON_FA_SQL = lexicon_sql("documents_lower", FA_LEMMA_SQL, FA_TAG_SQL)


def annotated_sql(source: str, key: str, column: str, lexicon: str = LEXICON_SQL) -> str:
    return (
        lexicon
        + ","
        + tokens_sql(source, key, column)
        + f""",
annotated AS (SELECT t.{key}, t.sent, t.pos, t.token, coalesce(b.lemma, t.token) AS lemma,
  coalesce(b.upos, 'X') AS upos FROM toks t LEFT JOIN best b ON b.token = t.token)"""
    )


def with_sql(*parts: str) -> str:
    return "WITH " + ",".join(parts)


# --- SQL forms of the text functions ------------------------------------------------------------


def sql_strip(c: str) -> str:
    return f"trim({c}, '{X.WS_CHARS}')"


def sql_words(c: str) -> str:
    return f"regexp_extract_all({c}, '{WORD}')"


def sql_model_tokens(c: str) -> str:
    return rf"regexp_extract_all(lower({c}), '{X.MODEL_TOKEN}')"


def sql_drop_punct(c: str) -> str:
    return f"regexp_replace({c}, '{X.PUNCTUATION}', '', 'g')"


def sql_to_persian(c: str) -> str:
    return f"translate({c}, '{X.ARABIC_YE}{X.ARABIC_KAF}{X.ZWNJ}', '{X.PERSIAN_YE}{X.PERSIAN_KAF}')"


def sql_to_arabic(c: str) -> str:
    return f"translate({c}, '{X.PERSIAN_YE}{X.PERSIAN_KAF}{X.TATWEEL}', '{X.ARABIC_YE}{X.ARABIC_KAF}')"


def sql_normalise(c: str) -> str:
    digits = f"translate({sql_to_persian(c)}, '{X.ARABIC_DIGITS}', '{X.PERSIAN_DIGITS}')"
    return sql_strip(f"regexp_replace({digits}, '[{X.WS}]+', ' ', 'g')")


def sql_clean_topic_words(c: str) -> str:
    """The words of a topic text before stop words go; one step per rule."""
    c = f"replace({c}, '{X.ZWNJ}', '')"
    c = sql_drop_punct(c)
    c = f"regexp_replace({c}, '{X.DIGITS}', '', 'g')"
    c = f"regexp_replace({c}, '[A-Za-z]', '', 'g')"
    return sql_words(c)
