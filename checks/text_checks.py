"""Text functions over every document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from checks import data as D
from checks.registry import check
from reviewlode.functions import text as X
from reviewlode.operators import lemmas
from reviewlode.operators import tokens as T
from reviewlode.session import land


def _text(name: str, spark_value: Callable[[Column], Column], sql_value: str, sql_source: str = "fa") -> None:
    """Register one expression over ``fa``; ``sql_value`` has ``{c}`` for the column."""
    sql = D.with_sql(D.DOCUMENT_SQL) + (
        f" SELECT doc_id AS review_id, {sql_value.replace('{c}', sql_source)} AS value FROM documents_fa"
    )

    @check(name, sql)
    def query(spark, sf_dir):
        rows = D.documents_fa(spark, sf_dir)
        return rows.select("review_id", spark_value(F.col("fa")).alias("value"))


def _padded(c: Column) -> Column:
    return F.concat(F.lit("\t   \n"), c, F.lit(" \r　"))


_PADDED_SQL = "concat('\t   \n', fa, ' \r　')"

_text("h1_strip", lambda c: X.strip(_padded(c)), D.sql_strip("{c}"), _PADDED_SQL)
_text("h2_to_persian", X.to_persian, D.sql_to_persian("{c}"))
_text("h3_to_arabic", X.to_arabic, D.sql_to_arabic("{c}"))
_text("h4_drop_zwnj", X.drop_zwnj, f"replace({{c}}, '{X.ZWNJ}', '')")
_text("h5_drop_punct", X.drop_punct, D.sql_drop_punct("{c}"))
_text("h6_drop_digits", X.drop_digits, f"regexp_replace({{c}}, '{X.DIGITS}', '', 'g')")
_text("h7_drop_latin", X.drop_latin, "regexp_replace({c}, '[A-Za-z]', '', 'g')")
_text("h8_lower", X.lower, "lower({c})")
_text(
    "h9_words",
    lambda c: F.array_join(X.words(c), "|"),
    "array_to_string(list_filter(regexp_split_to_array({c}, '[" + X.WS + "]+'), lambda w: w <> ''), '|')",
)
_text("h10_first_word", X.first_word, f"nullif(regexp_extract({{c}}, '{D.WORD}'), '')")
_text(
    "h11_last_segment",
    lambda c: X.last_segment(c, "."),
    D.sql_strip("list_extract(string_split({c}, '.'), -1)"),
)
_text(
    "h12_join_words",
    lambda c: X.join_words(X.words(c), "-"),
    f"array_to_string({D.sql_words('{c}')}, '-')",
)
_text(
    "h13_model_tokens",
    lambda c: F.array_join(X.model_tokens(c), "|"),
    f"array_to_string({D.sql_model_tokens('{c}')}, '|')",
)
_text("h14_normalise", X.normalise, D.sql_normalise("{c}"))
_text("h15_clean_train", X.clean_train, D.sql_normalise(f"lower({D.sql_drop_punct('{c}')})"))
_text("h16_clean_score", X.clean_score, D.sql_normalise(D.sql_drop_punct("coalesce({c}, '')")))
_text(
    "h20_build_keys",
    lambda c: F.concat_ws(
        ";",
        X.page_url(F.length(c), "https://example.org/room/", "/"),
        X.sheet_key(X.first_word(c), F.lit("SAD")),
        X.cluster_name(F.length(c) % 6),
    ),
    "concat_ws(';', 'https://example.org/room/' || length({c}) || '/', "
    f"concat_ws('_', nullif(regexp_extract({{c}}, '{D.WORD}'), ''), 'SAD'), "
    "'Cluster ' || (length({c}) % 6 + 1))",
)


# --- topic cleaners: the stop list is the corpus' own most frequent words -----------------------


def _clean_topic(name: str, map_letters: bool, compat: bool) -> None:
    mapped = D.sql_to_arabic("fa") if map_letters else "fa"
    stop_word = D.sql_to_arabic("word") if map_letters and not compat else "word"
    sql = (
        D.with_sql(D.DOCUMENT_SQL, D.stop_sql("documents_fa", D.sql_words("fa")))
        + f""", listed AS (SELECT list({stop_word}) AS words FROM stop)
        SELECT doc_id AS review_id, array_to_string(list_filter({D.sql_clean_topic_words(mapped)},
          lambda w: NOT list_contains(listed.words, w)), ' ') AS value
        FROM documents_fa, listed"""
    )

    @check(name, sql)
    def query(spark, sf_dir):
        rows = D.documents_fa(spark, sf_dir)
        stop = D.stop_list(rows, X.words(F.col("fa")))
        return rows.select(
            "review_id", X.clean_topic(F.col("fa"), stop, map_letters, compat).alias("value")
        )


_clean_topic("h17_clean_topic", True, False)
_clean_topic("h17_clean_topic_compat", True, True)
_clean_topic("h18_clean_topic_unmapped", False, False)


@check(
    "h19_clean_lemma",
    "WITH cleaned AS (SELECT doc_id, "
    + D.sql_normalise(f"lower({D.sql_drop_punct('text')})")
    + " AS text FROM documents),"
    + D.annotated_sql("cleaned", "doc_id", "text")
    + """ SELECT c.doc_id AS review_id,
      coalesce((SELECT string_agg(lemma, ' ' ORDER BY sent, pos) FROM annotated a WHERE a.doc_id = c.doc_id), '')
      AS comment FROM cleaned c""",
)
def h19_clean_lemma(spark, sf_dir):
    rows = D.documents(spark, sf_dir).select(F.col("doc_id").alias("review_id"), F.col("text").alias("comment"))
    return T.clean_lemma(rows, D.lexicon(spark, sf_dir))


# Words of the lexicon that occur twice play the unseen ones; rules come from all others.
_RULES_SQL = (
    D.LEXICON_SQL
    + """,
seen AS (SELECT * FROM best WHERE freq > 2),
edits AS (SELECT token, upos, length(token) - same AS cut, substring(lemma, same + 1) AS added FROM (SELECT *,
  len(list_filter(range(1, 1 + least(length(token), length(lemma))), lambda i: left(token, i) = left(lemma, i))) AS same FROM seen)),
votes AS (SELECT right(token, n) AS ending, cut, added, upos, count(*) AS words
  FROM edits, range(1, 6) t(n) WHERE n >= cut AND n < length(token) GROUP BY ALL),
rules AS (SELECT ending, cut, added, upos, words, total FROM (SELECT *, sum(words) OVER (PARTITION BY ending) AS total FROM votes)
  WHERE total >= 2 QUALIFY row_number() OVER (PARTITION BY ending ORDER BY words DESC, added DESC, cut DESC, upos DESC) = 1)"""
)


def _seen(spark, sf_dir):
    entries = T.best_entries(D.lexicon(spark, sf_dir)).join(
        D.lexicon(spark, sf_dir).groupBy("token").agg(F.max("freq").alias("freq")), "token"
    )
    entries = land(entries, "entries")
    return entries.where("freq > 2"), entries.where("freq = 2")


@check(
    "h19_ending_rules",
    D.with_sql(_RULES_SQL)
    + " SELECT ending, CAST(cut AS INTEGER) AS cut, added, upos, words, CAST(total AS BIGINT) AS total FROM rules",
)
def h19_ending_rules(spark, sf_dir):
    """The commonest edit and tag of every ending of the known words."""
    return lemmas.ending_rules(_seen(spark, sf_dir)[0])


@check(
    "h19_guess_lemmas",
    D.with_sql(_RULES_SQL)
    + """ SELECT token, left(token, length(token) - cut) || added AS lemma, upos FROM (SELECT b.token, r.*
      FROM best b, range(1, 6) t(n), rules r WHERE b.freq = 2 AND n < length(b.token) AND r.ending = right(b.token, n)
      QUALIFY row_number() OVER (PARTITION BY b.token ORDER BY n DESC) = 1)""",
)
def h19_guess_lemmas(spark, sf_dir):
    """Lemma and tag of every held-out word whose ending has a rule."""
    seen, held_out = _seen(spark, sf_dir)
    return lemmas.guess(held_out, land(lemmas.ending_rules(seen), "rules"))


@check(
    "h22_pad_left",
    # Every row has the longest length; zeros are all in front, as words have letters.
    "SELECT doc_id AS review_id, m AS length, m - len(t) AS zeros, "
    "CAST(coalesce(list_sum(list_transform(t, lambda x, i: x * (i + m - len(t)))), 0) AS BIGINT) AS checksum "
    "FROM (SELECT *, max(len(t)) OVER () AS m FROM "
    f"(SELECT doc_id, list_transform({D.sql_words('text')}, lambda w: length(w)) AS t FROM documents))",
)
def h22_pad_left(spark, sf_dir):
    lengths = F.transform(X.words(F.col("text")), lambda w: F.length(w))
    rows = D.documents(spark, sf_dir).select(F.col("doc_id").alias("review_id"), lengths.alias("ids"))
    padded = T.pad_sequences(rows, "ids")

    def digest(ids):
        def counted(zeros):
            # Zeros add nothing to the checksum, so only what stands behind them is summed entry by entry.
            entries = F.transform(F.slice(ids, zeros + 1, F.size(ids)), lambda x, i: x.cast("long") * (i + zeros + 1))
            return F.struct(
                F.size(ids).cast("long").alias("length"),
                zeros.cast("long").alias("zeros"),
                F.aggregate(entries, F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"),
            )

        return X.let(F.size(ids) - F.size(F.array_remove(ids, 0)), counted)

    return padded.select("review_id", X.let(F.col("ids"), digest).alias("d")).select("review_id", "d.*")
