"""Stop words, annotation, phrases, vocabulary, samples, folds and clusters."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from checks import data as D
from checks.registry import check
from reviewlode.functions import text as X
from reviewlode.operators import clusters, phrases, sampling, skew, topics
from reviewlode.operators import tokens as T


def _documents(spark, sf_dir, *columns):
    return D.documents(spark, sf_dir).select(F.col("doc_id").alias("review_id"), *columns)


# --- stop words ------------------------------------------------------------------------------

_STOP_REMOVED = (
    D.with_sql(D.stop_sql("documents", D.sql_model_tokens("text")))
    + f""", listed AS (SELECT list(word) AS words FROM stop)
    SELECT doc_id AS review_id, array_to_string(list_filter({D.sql_model_tokens('text')},
      lambda w: NOT list_contains(listed.words, w)), ' ') AS value FROM documents, listed"""
)


def _remove_words(spark, sf_dir, limit):
    rows = _documents(spark, sf_dir, X.model_tokens(F.col("text")).alias("words"))
    stop = D.stop_words(rows, F.col("words"))
    kept = T.remove_words(rows, "words", stop, limit=limit)
    return kept.select("review_id", F.array_join("words", " ").alias("value"))


@check("c4_remove_words", _STOP_REMOVED)
def c4_remove_words(spark, sf_dir):
    return _remove_words(spark, sf_dir, T.STOP_LITERALS)


@check("c4_remove_words_joined", _STOP_REMOVED)
def c4_remove_words_joined(spark, sf_dir):
    """The path for lists too long for a set."""
    return _remove_words(spark, sf_dir, 0)


# --- vocabulary and sequences --------------------------------------------------------------------

_SPACED = "regexp_replace(text, '[!\"#$%&()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~\\t\\n]', ' ', 'g')"
_SEQUENCE = f"list_filter(string_split(lower({_SPACED}), ' '), lambda w: w <> '')"
_VOCAB_SQL = f"""
seq AS (SELECT doc_id, {_SEQUENCE} AS t FROM documents),
word AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM seq),
counted AS (SELECT token, count(*) AS count, min(doc_id * 1000000 + pos) AS first_seen FROM word GROUP BY token),
vocab AS (SELECT token, count, row_number() OVER (ORDER BY count DESC, first_seen) AS id FROM counted)"""


def _sequences(spark, sf_dir):
    return _documents(spark, sf_dir, X.sequence_tokens(F.col("text")).alias("tokens"))


@check("d5_build_vocab", D.with_sql(_VOCAB_SQL) + " SELECT * FROM vocab")
def d5_build_vocab(spark, sf_dir):
    return T.build_vocab(_sequences(spark, sf_dir))


@check(
    "c5_encode_tokens",
    D.with_sql(_VOCAB_SQL)
    + """, known AS (SELECT * FROM vocab WHERE count >= 3),
    ids AS (SELECT doc_id, string_agg(id, ',' ORDER BY pos) AS ids FROM word JOIN known USING (token) GROUP BY doc_id)
    SELECT doc_id AS review_id, coalesce(ids, '') AS ids FROM documents LEFT JOIN ids USING (doc_id)""",
)
def c5_encode_tokens(spark, sf_dir):
    rows = _sequences(spark, sf_dir)
    known = T.build_vocab(rows).filter("count >= 3")
    encoded = T.encode_tokens(rows, known)
    return encoded.select("review_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@check("d3_max_len", D.with_sql(_VOCAB_SQL) + " SELECT CAST(max(len(t)) AS INTEGER) AS max_len FROM seq")
def d3_max_len(spark, sf_dir):
    return T.max_len(_sequences(spark, sf_dir), "tokens")


@check("d4_dynamic_min_df", "SELECT greatest(2, count(*) // 50) AS min_df FROM documents")
def d4_dynamic_min_df(spark, sf_dir):
    return T.dynamic_min_df(D.documents(spark, sf_dir))


@check(
    "d6_doc_freq",
    f"""SELECT term, count(DISTINCT doc_id) AS df FROM
      (SELECT doc_id, unnest({D.sql_model_tokens('text')}) AS term FROM documents)
    GROUP BY term HAVING count(DISTINCT doc_id) >= 5
      AND count(DISTINCT doc_id) <= 0.6 * (SELECT count(*) FROM documents)""",
)
def d6_doc_freq(spark, sf_dir):
    rows = _documents(spark, sf_dir, X.model_tokens(F.col("text")).alias("tokens"))
    return T.doc_freq(rows, "tokens", 5, 0.6)


@check(
    "e4_ngrams",
    f"""WITH t AS (SELECT doc_id, {D.sql_model_tokens('text')} AS w FROM documents)
    SELECT doc_id AS review_id, array_to_string(list_concat(w, list_concat(
      list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
      list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))), '|') AS value
    FROM t""",
)
def e4_ngrams(spark, sf_dir):
    grams = X.ngrams(X.model_tokens(F.col("text")), 1, 3)
    return _documents(spark, sf_dir, F.array_join(grams, "|").alias("value"))


# --- annotation and phrases ----------------------------------------------------------------------

_ANNOTATED = D.with_sql(D.annotated_sql("documents", "doc_id", "text"))


def _annotated(spark, sf_dir):
    rows = _documents(spark, sf_dir, F.col("text").alias("comment"))
    return T.annotate(rows, D.lexicon(spark, sf_dir))


@check(
    "c8_annotate",
    _ANNOTATED
    + """ SELECT d.doc_id AS review_id, coalesce(string_agg(a.sent || '/' || a.pos || '/' || a.token || '/'
      || a.lemma || '/' || a.upos, ' ' ORDER BY a.sent, a.pos), '') AS tokens
    FROM documents d LEFT JOIN annotated a ON a.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def c8_annotate(spark, sf_dir):
    rows = _annotated(spark, sf_dir)
    texts = F.transform(
        "tokens", lambda t: F.concat_ws("/", t["sent"], t["pos"], t["text"], t["lemma"], t["upos"])
    )
    return rows.select("review_id", F.array_join(texts, " ").alias("tokens"))


def _shape_tagger(texts):
    """A stand-in for a user's tagger: words of a text, long ones as nouns."""
    return texts.fillna("").map(
        lambda t: [(0, i, w, w.upper(), "NOUN" if len(w) > 3 else "X") for i, w in enumerate(re.findall(r"[A-Za-z]+", t))]
    )


@check(
    "k_annotate_with",
    """SELECT doc_id AS review_id, CAST(len(w) AS INTEGER) AS words,
      CAST(len(list_filter(w, lambda x: length(x) > 3)) AS INTEGER) AS nouns,
      array_to_string(list_transform(w, lambda x: upper(x)), ' ') AS lemmas
    FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents)""",
)
def k_annotate_with(spark, sf_dir):
    rows = T.annotate_with(_documents(spark, sf_dir, F.col("text").alias("comment")), _shape_tagger)
    nouns = F.filter("tokens", lambda t: t["upos"] == "NOUN")
    return rows.select(
        "review_id", F.size("tokens").alias("words"), F.size(nouns).alias("nouns"), T.lemma_text(F.col("tokens")).alias("lemmas")
    )


@check(
    "b14_keep_pos",
    _ANNOTATED + " SELECT doc_id AS review_id, token AS text, lemma FROM annotated WHERE upos = 'NOUN'",
)
def b14_keep_pos(spark, sf_dir):
    kept = _annotated(spark, sf_dir).select("review_id", F.explode(X.keep_pos(F.col("tokens"), ["NOUN"])).alias("t"))
    return kept.select("review_id", "t.text", "t.lemma")


@check(
    "e1_noun_adj_pairs",
    _ANNOTATED
    + """ SELECT doc_id AS review_id, token || ' ' || next_token AS pair FROM (SELECT *,
      lead(token) OVER w AS next_token, lead(upos) OVER w AS next_upos FROM annotated
      WINDOW w AS (PARTITION BY doc_id, sent ORDER BY pos)) WHERE upos = 'NOUN' AND next_upos = 'ADJ'""",
)
def e1_noun_adj_pairs(spark, sf_dir):
    pairs = F.explode(phrases.noun_adj_pairs(F.col("tokens")))
    return _annotated(spark, sf_dir).select("review_id", pairs.alias("pair"))


@check(
    "e2_noun_adj_tuples",
    _ANNOTATED
    + """ SELECT doc_id AS review_id, previous AS noun, token AS adj FROM (SELECT *,
      lag(token) OVER w AS previous, lag(upos) OVER w AS previous_upos FROM annotated
      WINDOW w AS (PARTITION BY doc_id, sent ORDER BY pos)) WHERE upos = 'ADJ' AND previous_upos = 'NOUN'""",
)
def e2_noun_adj_tuples(spark, sf_dir):
    pairs = _annotated(spark, sf_dir).select(
        "review_id", F.explode(phrases.noun_adj_tuples(F.col("tokens"))).alias("p")
    )
    return pairs.select("review_id", "p.noun", "p.adj")


@check(
    "e3_noun_adj_runs",
    _ANNOTATED
    + """, marked AS (SELECT *, sum(CASE WHEN upos IN ('NOUN', 'ADJ') THEN 0 ELSE 1 END) OVER
      (PARTITION BY doc_id, sent ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM annotated)
    SELECT doc_id AS review_id, string_agg(lemma, ' ' ORDER BY pos) AS run FROM marked
    WHERE upos IN ('NOUN', 'ADJ') GROUP BY doc_id, sent, island HAVING count(*) > 1""",
)
def e3_noun_adj_runs(spark, sf_dir):
    runs = F.explode(phrases.noun_adj_runs(F.col("tokens")))
    return _annotated(spark, sf_dir).select("review_id", runs.alias("run"))


# --- numbering, samples, folds -----------------------------------------------------------------


@check(
    "e5_number_rows",
    "SELECT doc_id AS review_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS row_number FROM documents",
)
def e5_number_rows(spark, sf_dir):
    rows = _documents(spark, sf_dir, "n_chars")
    numbered = skew.number_rows(rows, [F.desc("n_chars"), F.col("review_id")])
    return numbered.select("review_id", "row_number")


@check(
    "e6_assign_folds",
    D.with_sql(D.REVIEWS_SQL)
    + """, sorted AS (SELECT review_id, sentiment AS label, row_number() OVER (ORDER BY sentiment, review_id) - 1 AS p
      FROM reviews WHERE sentiment IS NOT NULL),
    dealt AS (SELECT label, p % 5 AS fold, count(*) AS size FROM sorted GROUP BY ALL),
    upto AS (SELECT label, fold, sum(size) OVER (PARTITION BY label ORDER BY fold) AS upto FROM dealt),
    placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY review_id) AS n FROM sorted)
    SELECT review_id, p.label, CAST(min(u.fold) AS INTEGER) AS fold FROM placed p JOIN upto u
      ON u.label = p.label AND u.upto >= p.n GROUP BY review_id, p.label""",
)
def e6_assign_folds(spark, sf_dir):
    rows = D.labelled(spark, sf_dir).select("review_id", "label")
    return sampling.assign_folds(rows, 5, by="label")


@check(
    "e6_contiguous_folds",
    "SELECT doc_id AS review_id, CAST(ntile(3) OVER (ORDER BY doc_id) - 1 AS INTEGER) AS fold FROM documents",
)
def e6_contiguous_folds(spark, sf_dir):
    return sampling.assign_folds(_documents(spark, sf_dir), 3)


@check(
    "f4_sample_fraction",
    """SELECT doc_id AS review_id, text AS comment FROM documents QUALIFY
      row_number() OVER (ORDER BY md5('42:' || doc_id)) <= (SELECT round(0.1 * count(*)) FROM documents)""",
)
def f4_sample_fraction(spark, sf_dir):
    return sampling.sample_fraction(_documents(spark, sf_dir, F.col("text").alias("comment")), 0.1)


@check(
    "f5_split",
    """SELECT doc_id AS review_id, CAST(row_number() OVER (ORDER BY md5('42:' || doc_id))
      <= (SELECT ceil(0.2 * count(*)) FROM documents) AS INTEGER) AS held_out FROM documents""",
)
def f5_split(spark, sf_dir):
    rows = _documents(spark, sf_dir)
    return rows.withColumn("held_out", sampling.split_flag(rows).cast("int"))


# --- clusters --------------------------------------------------------------------------------

_CLUSTERED_SQL = f"""
clustered AS (SELECT doc_id, CAST(doc_id // 7 % 10 AS INTEGER) AS cluster, text FROM documents),
cluster_words AS (SELECT doc_id, cluster, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT doc_id, cluster, {D.sql_words('text')} AS w FROM clustered)),
word_counts AS (SELECT cluster, word, count(*) AS count, min(doc_id * 1000000 + pos) AS first_seen
  FROM cluster_words GROUP BY cluster, word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY count DESC, first_seen) AS rank
  FROM word_counts),
named AS (SELECT c.cluster, 'Cluster ' || (c.cluster + 1) AS name,
    coalesce(string_agg(r.word, ' ' ORDER BY r.rank), '') AS top_words, count(r.word) AS n_words
  FROM (SELECT DISTINCT cluster FROM clustered) c LEFT JOIN ranked r ON r.cluster = c.cluster AND r.rank <= 5
  GROUP BY c.cluster)"""


def _clustered(spark, sf_dir):
    """All documents in ten clusters by their id."""
    cluster = F.expr("cast(doc_id div 7 % 10 as int)").alias("cluster")
    return D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"), F.col("text").alias("comment"), cluster)


@check("d7_cluster_word_counts", D.with_sql(_CLUSTERED_SQL) + " SELECT cluster, word, count FROM word_counts")
def d7_cluster_word_counts(spark, sf_dir):
    return clusters.cluster_word_counts(_clustered(spark, sf_dir)).select("cluster", "word", "count")


@check(
    "d8_concat_group",
    D.with_sql(_CLUSTERED_SQL)
    + " SELECT cluster, doc_id // 100 AS chunk, string_agg(text, ' ' ORDER BY doc_id) AS text "
    "FROM clustered GROUP BY ALL",
)
def d8_concat_group(spark, sf_dir):
    return clusters.concat_group(_clustered(spark, sf_dir))


@check("d9_n_clusters", D.with_sql(_CLUSTERED_SQL) + " SELECT count(DISTINCT cluster) AS n_clusters FROM clustered")
def d9_n_clusters(spark, sf_dir):
    return clusters.n_clusters(_clustered(spark, sf_dir))


@check(
    "f2_top_words",
    D.with_sql(_CLUSTERED_SQL)
    + " SELECT cluster, CAST(rank AS INTEGER) AS rank, word, count FROM ranked WHERE rank <= 5",
)
def f2_top_words(spark, sf_dir):
    return clusters.top_words(_clustered(spark, sf_dir))


@check(
    "f3_order_clusters",
    D.with_sql(_CLUSTERED_SQL)
    + " SELECT cluster, CAST(row_number() OVER (ORDER BY n_words DESC, cluster) AS BIGINT) AS place FROM named",
)
def f3_order_clusters(spark, sf_dir):
    topics_table = clusters.cluster_topics(_clustered(spark, sf_dir))
    order = [F.desc(F.size("top_words")), F.col("cluster")]
    return skew.number_rows(clusters.order_clusters(topics_table), order, "place").select("cluster", "place")


@check("i20_cluster_topics", D.with_sql(_CLUSTERED_SQL) + " SELECT cluster, name, top_words FROM named")
def i20_cluster_topics(spark, sf_dir):
    report = clusters.cluster_topics(_clustered(spark, sf_dir))
    return report.withColumn("top_words", F.array_join("top_words", " "))


@check(
    "g2_dedupe_topics",
    """SELECT lang, source AS topic, min(doc_id) AS topic_id, arg_max(n_chars, doc_id) AS importance
    FROM documents GROUP BY lang, source""",
)
def g2_dedupe_topics(spark, sf_dir):
    rows = D.documents(spark, sf_dir).select(
        "lang",
        F.col("source").alias("topic"),
        F.col("doc_id").alias("topic_id"),
        F.col("n_chars").alias("importance"),
    )
    return topics.dedupe_topics(rows, ("lang",))
