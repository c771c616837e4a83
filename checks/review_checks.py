"""Sources, filters, merges, lookups and counts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import data as D
from checks.registry import check
from reviewlode.functions import text as X
from reviewlode.operators import cleaning, grouping, merging
from reviewlode.session import work_dir
from reviewlode.schema import NA_TOKENS
from reviewlode.sources import pages as P
from reviewlode.sources import readers, sinks
from reviewlode.streaming.append import append_new_pages

# --- sources ---------------------------------------------------------------------------------


@check(
    "a3_read_labelled",
    D.with_sql(D.REVIEWS_SQL)
    + " SELECT comment, sentiment AS label FROM reviews WHERE sentiment IS NOT NULL",
)
def a3_read_labelled(spark, sf_dir):
    path = _scratch(spark, "labelled")
    D.labelled(spark, sf_dir).write.parquet(path)
    return readers.read_labelled(spark, path)


def _scratch(spark, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


_NULLS = ", ".join(f"'{t}'" for t in NA_TOKENS)


@check(
    "a1_read_reviews",
    D.with_sql(D.REVIEWS_SQL)
    + " SELECT page, "
    + ", ".join(
        f"CASE WHEN {c} NOT IN ({_NULLS}) THEN {c} END AS {c}" for c in ("location", "room_type", "comment", "sentiment")
    )
    + " FROM reviews",
)
def a1_read_reviews(spark, sf_dir):
    """Every review through the CSV dialect: quotes, line breaks, outer blanks and null spellings."""
    path = _scratch(spark, "csv")
    sinks.write_table(D.reviews(spark, sf_dir).drop("review_id"), path, "csv")
    return readers.read_reviews(spark, path)


_WORD_LINES_SQL = f"SELECT DISTINCT unnest({D.sql_words('text')}) AS w FROM documents"


def _word_file(spark, sf_dir) -> str:
    """A list of all words with stray blanks on some lines and a blank line for each."""
    words = D.documents(spark, sf_dir).select(F.explode(X.words(F.col("text"))).alias("w")).distinct()
    padded = F.when(F.length("w") > 5, F.concat(F.lit(" "), "w", F.lit("\t"))).otherwise(F.col("w"))
    path = _scratch(spark, "words")
    words.select(F.explode(F.array(padded, F.lit(" "))).alias("value")).write.text(path)
    return path


@check("a4_read_wordlist", f"SELECT w AS word FROM ({_WORD_LINES_SQL})")
def a4_read_wordlist(spark, sf_dir):
    return readers.read_wordlist(spark, _word_file(spark, sf_dir))


@check(
    "a5_read_raw_wordlist",
    f"SELECT CASE WHEN length(w) > 5 THEN ' ' || w || '\t' ELSE w END AS word FROM ({_WORD_LINES_SQL}) "
    f"UNION ALL SELECT ' ' AS word FROM ({_WORD_LINES_SQL})",
)
def a5_read_raw_wordlist(spark, sf_dir):
    return readers.read_wordlist(spark, _word_file(spark, sf_dir), strip=False)


@check(
    "a6_page_urls",
    "SELECT i AS page_id, 'https://example.org/room/' || i || '/' AS url "
    "FROM (SELECT unnest(range(min(page_id), max(page_id) + 1)) AS i FROM pages)",
)
def a6_page_urls(spark, sf_dir):
    first, last = D.table(spark, sf_dir, "pages").agg(F.min("page_id"), F.max("page_id")).first()
    return readers.page_urls(spark, "https://example.org/room/", first, last, "/")


LAYOUT_ONE = P.PageRules(
    container=r"<p\b[^<>]*>",
    text=r"(?s)\A(.*?)</p>",
    location=r'<html lang="(.*?)"',
    heading=r"(?s)<h1\b[^<>]*>(.*?)</h1>",
    heading_first_word=True,
    keep_empty=True,
)
LAYOUT_TWO = P.PageRules(
    container=r"<p\b[^<>]*>",
    text=r"(?s)\A(.*?)</p>",
    location=r"(?s)<title>(.*?)</title>",
    heading=r"(?s)<h1\b[^<>]*>(.*?)</h1>",
    location_separator=" ",
)


def _html_text(c: str) -> str:
    c = f"regexp_replace({c}, '[ \\t\\r\\n\\f]+', ' ', 'g')"
    c = f"regexp_replace({c}, '(?i) ?<(?:br|/p|/div|/li)\\b[^<>]*> ?', chr(10), 'g')"
    c = f"regexp_replace({c}, '<[^<>]*>', '', 'g')"
    for entity, sign in (
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"),
    ):
        c = f"replace({c}, '{entity}', '{sign}')"
    return D.sql_strip(c)


def _pages_sql(rules: P.PageRules) -> str:
    place = _html_text(f"regexp_extract(html, '{rules.location}', 1)")
    if rules.location_separator:
        place = D.sql_strip(f"list_extract(string_split({place}, '{rules.location_separator}'), -1)")
    title = _html_text(f"regexp_extract(html, '{rules.heading}', 1)")
    if rules.heading_first_word:
        title = f"regexp_extract({title}, '{D.WORD}')"
    kept = "" if rules.keep_empty else "WHERE comment <> ''"
    return f"""SELECT * FROM (SELECT page_id AS page, coalesce(nullif({place}, ''), 'N/A') AS location,
        coalesce(nullif({title}, ''), 'N/A') AS room_type,
        {_html_text(f"regexp_extract(body, '{rules.text}', 1)")} AS comment
      FROM (SELECT page_id, html, unnest(list_slice(parts, 2, len(parts))) AS body
            FROM (SELECT *, string_split_regex(html, '{rules.container}') AS parts FROM pages))
      WHERE regexp_matches(body, '{rules.text}')) {kept}"""


@check("a7_extract_reviews", _pages_sql(LAYOUT_ONE))
def a7_extract_reviews(spark, sf_dir):
    return P.extract_reviews(D.pages(spark, sf_dir), LAYOUT_ONE)


# --- the two layouts, built from titles and addresses, whose texts are known without any pattern of a layout

_TITLE = r"trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[ \t\r\n\f]+', ' ', 'g'))"


def _known_sql(title: str, kept: str) -> str:
    return f"""SELECT page_id AS page, t AS location, {title} AS room_type, comment FROM (
        SELECT page_id, t, unnest([t || chr(10) || url || ' & <' || t || '>', '', 'خوب' || chr(8204) || 'تر ' || t || ' é']) AS comment
        FROM (SELECT page_id, url, {_TITLE} AS t FROM pages)) {kept}"""


def _layout(spark, sf_dir, page, comment):
    """Pages of one layout: titles and addresses escaped, with tags, breaks and references in between.

    A text holds elements of its own name, comments and scripts that look like its end.
    """
    title = F.trim(F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "[ \\t\\r\\n\\f]+", " "))

    def escaped(c):
        for sign, reference in (("&", "&#x26;"), ("<", "&lt;"), ("é", "&#233;"), (" ", " \n ")):
            c = F.replace(c, F.lit(sign), F.lit(reference))
        return c

    t, url = escaped(title), escaped(F.col("url"))
    bodies = [
        F.concat(F.lit("<b>"), t, F.lit("</b><BR/>"), url, F.lit(" &amp; &lt;<i><u>"), t, F.lit("</u></i>&gt;")),
        F.lit("<span></span>"),
        F.concat(F.lit("خوب&zwnj;<em>تر</em>&nbsp;"), t, F.lit(" &#xe9;")),
    ]
    blocks = F.concat(*[part for body in bodies for part in (F.lit(comment[0]), body, F.lit(comment[1]))])
    html = F.concat(*[{"T": t, "C": blocks}.get(x, F.lit(x)) for x in page])
    return D.pages(spark, sf_dir).select("page_id", "url", html.alias("html"))


@check("a7_site_one", _known_sql(f"regexp_extract(t, '{D.WORD}')", ""))
def a7_site_one(spark, sf_dir):
    page = (
        '<html><a class="y" href="/province/1"><i></i><span itemprop="name"> ', "T", "</span></a>"
        '<h1 class="my-Typography_h1__JESPs text-Asphalt">no</h1>'
        "<h1 id=1 class='big text-Asphalt  Typography_h1__JESPs'><span></span> <em>", "T", "</em></h1>", "C", "</html>",
    )
    comment = (
        '<div class="Comments_commentBody__Tl_lO"><p class="other">no</p>'
        "<div class='text-justify Typography_caption3__epLLG text-Charcoal'><div><!-- </div> --><script>'</div>'</script>",
        '</div></div><p class="Typography_caption3__epLLG text-Charcoal text-justify">second</p></div>'
        '<div class="Comments_commentBody__Tl_lO-x">no</div>',
    )
    return P.extract_reviews(_layout(spark, sf_dir, page, comment), P.SITE_ONE)


@check("a8_site_two", _known_sql("t", "WHERE comment <> ''"))
def a8_site_two(spark, sf_dir):
    page = (
        '<html><p class="comment-card__text">outside</p><em class="city-province">no</em>'
        '<strong class="city-province"> x، ', "T", "</strong>"
        "<h2 class='a pdp-host-info-content__title'><b>", "T", "</b></h2>", "C", "</html>",
    )
    comment = (
        '<div class="comment-card__content"><div class="comment-card__text">no</div>'
        '<p class="my-comment-card__text">no</p><p class="comment-card__text"><!-- </p> --><style></p></style>',
        "<div>behind the paragraph</div></p></div>",
    )
    return P.extract_reviews(_layout(spark, sf_dir, page, comment), P.SITE_TWO)


@check("a8_extract_reviews", _pages_sql(LAYOUT_TWO))
def a8_extract_reviews(spark, sf_dir):
    return P.extract_reviews(D.pages(spark, sf_dir), LAYOUT_TWO)


@check("a9_append_reviews", f"{_pages_sql(LAYOUT_ONE)} UNION ALL {_pages_sql(LAYOUT_TWO)}")
def a9_append_reviews(spark, sf_dir):
    path = _scratch(spark, "appended")
    sinks.append_reviews(a7_extract_reviews(spark, sf_dir), path)
    sinks.append_reviews(a8_extract_reviews(spark, sf_dir), path)
    return spark.read.parquet(path)


@check("a9_append_new_pages", _pages_sql(LAYOUT_TWO))
def a9_append_new_pages(spark, sf_dir):
    """Two runs over the same stored pages: the second finds nothing new."""
    path, name = _scratch(spark, "streamed"), uuid.uuid4().hex
    for _ in range(2):
        append_new_pages(spark, f"{sf_dir}/pages*.parquet", LAYOUT_TWO, path, name).awaitTermination()
    return spark.read.parquet(path)


@check("a10_write_table", _pages_sql(LAYOUT_ONE))
def a10_write_table(spark, sf_dir):
    path = _scratch(spark, "table")
    sinks.write_table(a8_extract_reviews(spark, sf_dir), path)
    sinks.write_table(a7_extract_reviews(spark, sf_dir), path)
    return spark.read.parquet(path)


def _slices(spark, sf_dir):
    """Counts per room type and sentiment, as a stand-in for a topic table."""
    rows = D.reviews(spark, sf_dir).filter("sentiment IS NOT NULL")
    return rows.groupBy("room_type", "sentiment").agg(F.count(F.lit(1)).alias("n"))


_SLICES_SQL = (
    D.with_sql(D.REVIEWS_SQL)
    + ", slices AS (SELECT room_type, sentiment, count(*) AS n FROM reviews "
    "WHERE sentiment IS NOT NULL GROUP BY ALL)"
)


@check("a11_write_by_sentiment", _SLICES_SQL + " SELECT * FROM slices")
def a11_write_by_sentiment(spark, sf_dir):
    path = _scratch(spark, "sheets")
    sinks.write_topics(_slices(spark, sf_dir), path)
    return sinks.read_topics(spark, path)


@check("a12_write_by_group", _SLICES_SQL + " SELECT *, room_type || '_' || sentiment AS sheet FROM slices")
def a12_write_by_group(spark, sf_dir):
    path = _scratch(spark, "sheets")
    sinks.write_topics(_slices(spark, sf_dir), path, ("room_type", "sentiment"))
    return sinks.with_sheet_key(sinks.read_topics(spark, path))


@check(
    "a13_replace_slice",
    _SLICES_SQL + " SELECT room_type, sentiment, CASE sentiment WHEN 'SAD' THEN -n ELSE n END AS n FROM slices",
)
def a13_replace_slice(spark, sf_dir):
    path = _scratch(spark, "sheets")
    slices = _slices(spark, sf_dir)
    sinks.write_topics(slices, path)
    sinks.write_topics(slices.filter("sentiment = 'SAD'").withColumn("n", -F.col("n")), path, replace=True)
    return sinks.read_topics(spark, path)


@check("g1_union_all", f"{_pages_sql(LAYOUT_ONE)} UNION ALL {_pages_sql(LAYOUT_TWO)}")
def g1_union_all(spark, sf_dir):
    return merging.union_all(a7_extract_reviews(spark, sf_dir), a8_extract_reviews(spark, sf_dir))


@check(
    "b10_normalise_names",
    "SELECT page_id, url AS page_url, html AS page_text FROM pages",
)
def b10_normalise_names(spark, sf_dir):
    rows = D.pages(spark, sf_dir).select(
        F.col("page_id").alias(" Page ID"), F.col("url").alias("PAGE url "), F.col("html").alias("Page Text")
    )
    return readers.normalise_names(rows)


# --- filters and projections --------------------------------------------------------------------


def _on_reviews(name: str, sql: str):
    return check(name, D.with_sql(D.REVIEWS_SQL) + " " + sql)


@_on_reviews("b1_drop_null", "SELECT review_id, sentiment FROM reviews WHERE sentiment IS NOT NULL")
def b1_drop_null(spark, sf_dir):
    return cleaning.drop_null(D.reviews(spark, sf_dir), "sentiment").select("review_id", "sentiment")


@_on_reviews("b2_min_chars", "SELECT review_id, comment FROM reviews WHERE length(comment) >= 5")
def b2_min_chars(spark, sf_dir):
    return cleaning.min_chars(D.reviews(spark, sf_dir)).select("review_id", "comment")


@check(
    "b3_exclude_pattern",
    f"SELECT doc_id AS review_id, comment FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN text "
    f"ELSE translate(lower(text), '{D.LATIN}', '{D.PERSIAN}') END AS comment FROM documents) "
    "WHERE NOT regexp_matches(comment, '[a-zA-Z]')",
)
def b3_exclude_pattern(spark, sf_dir):
    text = F.when(F.col("lang") == "en", F.col("text")).otherwise(D.persian(F.lower("text")))
    rows = D.documents(spark, sf_dir).select(F.col("doc_id").alias("review_id"), text.alias("comment"))
    return cleaning.exclude_pattern(rows)


@_on_reviews("b3_exclude_digits", "SELECT review_id, comment FROM reviews WHERE NOT regexp_matches(comment, '[0-9]')")
def b3_exclude_digits(spark, sf_dir):
    return cleaning.exclude_pattern(D.reviews(spark, sf_dir), pattern="[0-9]").select("review_id", "comment")


@_on_reviews("b4_by_sentiment", "SELECT comment FROM reviews WHERE sentiment = 'SAD' AND comment IS NOT NULL")
def b4_by_sentiment(spark, sf_dir):
    return cleaning.by_sentiment(D.reviews(spark, sf_dir), "SAD")


@_on_reviews(
    "b5_by_group",
    "SELECT review_id, room_type, sentiment FROM reviews WHERE room_type = 'سوئیت' AND sentiment = 'HAPPY'",
)
def b5_by_group(spark, sf_dir):
    rows = cleaning.by_group(D.reviews(spark, sf_dir), "سوئیت", "HAPPY")
    return rows.select("review_id", "room_type", "sentiment")


@_on_reviews("b6_min_words", f"SELECT review_id, comment FROM reviews WHERE len({D.sql_words('comment')}) >= 3")
def b6_min_words(spark, sf_dir):
    return cleaning.min_words(D.reviews(spark, sf_dir)).select("review_id", "comment")


@_on_reviews(
    "b7_drop_empty",
    "SELECT review_id, room_type FROM reviews WHERE room_type <> ''",
)
def b7_drop_empty(spark, sf_dir):
    return cleaning.drop_empty(D.reviews(spark, sf_dir), "room_type").select("review_id", "room_type")


@_on_reviews("b8_project_comment", "SELECT comment FROM reviews")
def b8_project_comment(spark, sf_dir):
    return D.reviews(spark, sf_dir).select("comment")


@_on_reviews(
    "b9_overwrite_column",
    f"SELECT review_id, page, location, {D.sql_to_persian(D.sql_strip('room_type'))} AS room_type, "
    "coalesce(sentiment, 'UNKNOWN') AS sentiment FROM reviews",
)
def b9_overwrite_column(spark, sf_dir):
    rows = grouping.clean_room_type(D.reviews(spark, sf_dir)).drop("comment")
    return rows.withColumn("sentiment", F.coalesce("sentiment", F.lit("UNKNOWN")))


@_on_reviews("b11_text_or_empty", "SELECT review_id, coalesce(sentiment, '') AS value FROM reviews")
def b11_text_or_empty(spark, sf_dir):
    return D.reviews(spark, sf_dir).select("review_id", X.text_or_empty(F.col("sentiment")).alias("value"))


@_on_reviews(
    "b12_missing_fields",
    "SELECT review_id, coalesce(nullif(room_type, ''), 'N/A') AS written, "
    "CASE WHEN coalesce(nullif(room_type, ''), 'N/A') <> 'N/A' THEN room_type END AS read_back FROM reviews",
)
def b12_missing_fields(spark, sf_dir):
    written = D.reviews(spark, sf_dir).select("review_id", X.default_na(F.col("room_type")).alias("written"))
    return written.withColumn("read_back", X.na_to_null(F.col("written")))


@check(
    "b13_to_class",
    "SELECT vec_id, CAST(label / 9.0 > 0.5 AS INTEGER) AS class, "
    "CAST(embedding[1] > 0 AS INTEGER) AS first_positive FROM embeddings",
)
def b13_to_class(spark, sf_dir):
    return D.table(spark, sf_dir, "embeddings").select(
        "vec_id",
        X.to_class(F.col("label") / 9.0).alias("class"),
        X.to_class(F.get("embedding", 0), 0.0).alias("first_positive"),
    )


# --- merge -----------------------------------------------------------------------------------

_SOURCES_SQL = """
a AS (SELECT n_chars AS page, CASE WHEN lang <> 'es' THEN lang END AS location, source AS room_type,
        text AS comment FROM documents),
b AS (SELECT n_chars AS page, CASE WHEN lang <> 'es' THEN lang END AS location,
        CASE WHEN toxic = 1 THEN source || '!' ELSE source END AS room_type, text AS comment
      FROM documents JOIN labels USING (doc_id)),
merged AS (SELECT coalesce(a.page, b.page) AS page, coalesce(a.location, b.location) AS location,
        coalesce(a.room_type, b.room_type) AS room_type, coalesce(a.comment, b.comment) AS comment
      FROM a FULL JOIN b ON a.page IS NOT DISTINCT FROM b.page AND a.location IS NOT DISTINCT FROM b.location
        AND a.room_type IS NOT DISTINCT FROM b.room_type AND a.comment IS NOT DISTINCT FROM b.comment)"""


def _sources(spark, sf_dir):
    """All documents, and the labelled ones with some keys changed: matches, copies and rests on both sides."""
    rows = D.documents(spark, sf_dir).select(
        "doc_id",
        F.col("n_chars").alias("page"),
        F.when(F.col("lang") != "es", F.col("lang")).alias("location"),
        F.col("source").alias("room_type"),
        F.col("text").alias("comment"),
    )
    labels = D.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    changed = F.when(F.col("toxic") == 1, F.concat("room_type", F.lit("!"))).otherwise(F.col("room_type"))
    b = rows.join(labels, "doc_id").withColumn("room_type", changed)
    return rows.drop("doc_id"), b.drop("doc_id", "toxic")


@check("c1_merge_sources", D.with_sql(_SOURCES_SQL) + " SELECT * FROM merged")
def c1_merge_sources(spark, sf_dir):
    return merging.merge_sources(*_sources(spark, sf_dir))


@check(
    "c1_merge_counts",
    D.with_sql(_SOURCES_SQL)
    + " SELECT page, location, room_type, comment, count(*) AS n_rows FROM merged GROUP BY ALL",
)
def c1_merge_counts(spark, sf_dir):
    return merging.merge_counts(*_sources(spark, sf_dir))


@check("f6_ordered_merge", D.with_sql(_SOURCES_SQL) + " SELECT * FROM merged ORDER BY ALL")
def f6_ordered_merge(spark, sf_dir):
    return merging.merge_sources(*_sources(spark, sf_dir), ordered=True)


# --- lookups and counts ------------------------------------------------------------------------

_GROUP_CASE = (
    "CASE "
    + " ".join(
        f"WHEN {D.sql_to_persian(D.sql_strip('room_type'))} = '{value}' THEN '{group}'"
        for group, values in grouping.ROOM_TYPE_GROUPS.items()
        for value in values
    )
    + " END"
)


@_on_reviews("c2_map_values", f"SELECT review_id, {_GROUP_CASE} AS room_type FROM reviews")
def c2_map_values(spark, sf_dir):
    return grouping.group_room_types(D.reviews(spark, sf_dir)).select("review_id", "room_type")


@check("c3_invert_mapping", "SELECT source AS value, max(lang) AS \"group\" FROM documents GROUP BY source")
def c3_invert_mapping(spark, sf_dir):
    # Position of a group: its two letters as a number, so the alphabetically last group wins.
    order = F.ascii("group") * 256 + F.ascii(F.substring("group", 2, 1))
    pairs = D.documents(spark, sf_dir).select(F.col("lang").alias("group"), "source").distinct()
    mapping = pairs.select("group", F.array("source").alias("values"))
    return grouping.invert_mapping(mapping.withColumn("position", order))


@_on_reviews(
    "d1_value_counts",
    f"SELECT room_type, count(*) AS count FROM (SELECT {_GROUP_CASE} AS room_type FROM reviews "
    "WHERE length(comment) >= 5) WHERE room_type IS NOT NULL GROUP BY room_type",
)
def d1_value_counts(spark, sf_dir):
    rows = cleaning.min_chars(cleaning.drop_null(D.reviews(spark, sf_dir)))
    return grouping.value_counts(grouping.group_room_types(rows), "room_type")


@_on_reviews("d2_distinct_values", "SELECT DISTINCT sentiment FROM reviews")
def d2_distinct_values(spark, sf_dir):
    return grouping.distinct_values(D.reviews(spark, sf_dir), "sentiment")
