import os

import pytest
from pyspark.sql import functions as F

from reviewlode.sources import pages as P
from reviewlode.sources import readers, sinks
from reviewlode.streaming.append import append_new_pages

PAGE_ONE = """<html><a class="x" href='/province/1'><b></b><span itemprop='name'> شیراز </span></a>
<h1 class="big Typography_h1__JESPs text-Asphalt">ویلا در <i>شمال</i></h1>
<div class="Comments_commentBody__Tl_lO"><div><p class="Typography_caption3__epLLG text-Charcoal text-justify"> عالی
 بود </p></div></div>
<div class="Comments_commentBody__Tl_lO"><p class="other">بی متن</p></div>
<div class="Comments_commentBody__Tl_lO"><p class="text-justify Typography_caption3__epLLG text-Charcoal"></p></div>
<div class="Comments_commentBody__Tl_lO"><p class="Typography_caption3__epLLG text-Charcoal text-justify">a &amp; b</p></div></html>"""
PAGE_TWO = """<strong class="city-province">استان فارس، شیراز </strong><h2 class="pdp-host-info-content__title"> خانه ویلایی </h2>
<div class="comment-card__content"><p class="comment-card__text">خوب</p></div>
<div class="comment-card__content"><p class="comment-card__text"> </p></div>"""
BARE = '<div class="comment-card__content"><p class="comment-card__text">تنها</p></div>'


def frame(spark, *pages):
    rows = [(i, f"u{i}", html) for i, html in enumerate(pages)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_site_one(spark):
    rows = P.extract_reviews(frame(spark, PAGE_ONE, "<html></html>"), P.SITE_ONE).collect()
    assert [(r.page, r.location, r.room_type) for r in rows] == [(0, "شیراز", "ویلا")] * 3
    assert [r.comment for r in rows] == ["عالی بود", "", "a & b"]


def test_long_broken_pages(spark):
    """Unclosed elements and stray signs over a long page neither fail nor hide its comments."""
    filler = "<b x" * 10_000 + "ب" * 50_000
    broken = PAGE_ONE.replace("</a>", filler).replace("</html>", filler)
    rows = P.extract_reviews(frame(spark, broken), P.SITE_ONE).collect()
    assert [r.comment for r in rows] == ["عالی بود", "", "a & b"]
    assert {(r.location, r.room_type) for r in rows} == {("N/A", "ویلا")}
    two = P.extract_reviews(frame(spark, PAGE_ONE.replace("<html>", "<a href='/province/0'>x</a>")), P.SITE_ONE)
    assert two.first().location == "شیراز"


def test_site_two(spark):
    rows = P.extract_reviews(frame(spark, PAGE_TWO, BARE), P.SITE_TWO).collect()
    assert [tuple(r) for r in rows] == [
        (0, "شیراز", "خانه ویلایی", "خوب"),
        (1, "N/A", "N/A", "تنها"),
    ]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("خوب <b>تمیز</b> آرام", "خوب تمیز آرام"),
        ("می&zwnj;روم<br>عالی &#1705;", "می\u200cروم\nعالی ک"),
        ("&amp;lt; &#38;lt; &#x26;amp; &#0; &#xD800; &#99999999;", "&lt; &lt; &amp; \ufffd \ufffd &#99999999;"),
        (" a \n\t b <BR /> c<div>d</div>e ", "a b\nc" + "d\ne"),
        (None, None),
    ],
)
def test_visible_text(spark, html, text):
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(P.html_text(F.col("html")).alias("x")).first().x == text


def test_inner_tags_and_class_names(spark):
    inner = PAGE_ONE.replace("عالی\n بود", "خوب <b>تمیز</b> آرام").replace("ویلا در", "<span></span>ویلا")
    rows = P.extract_reviews(frame(spark, inner), P.SITE_ONE).collect()
    assert rows[0].comment == "خوب تمیز آرام" and rows[0].room_type == "ویلا"
    other = BARE.replace('"comment-card__text"', '"my-comment-card__text"')
    assert P.extract_reviews(frame(spark, other), P.SITE_TWO).count() == 0
    single = BARE.replace('"', "'")
    assert P.extract_reviews(frame(spark, single), P.SITE_TWO).first().comment == "تنها"
    assert P.extract_reviews(frame(spark, '<p class="comment-card__text">x</p>'), P.SITE_TWO).count() == 0


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ("A <div>inner</div> tail words", "A inner\ntail words"),
        ("<div><div>a</div><div>b</div></div>c", "a\nb\n\nc"),
        ("a<!-- </div> --> b<script>var x = '</div>';</script> c<style>div{}</div></style>", "a b c"),
        ("caf&eacute; &notin; &nosuchname; &AMP;lt; &amp;eacute;", "café ∉ &nosuchname; &lt; &eacute;"),
        ("<DIV>upper</DIV > lower <divider>x</divider>", "upper\nlower x"),
        ("stray </b> and </span> signs", "stray and signs"),
    ],
)
def test_an_element_ends_at_its_own_closing_tag(spark, inner, text):
    page = PAGE_ONE.replace(
        '<p class="other">بی متن</p>', f'<div class="Typography_caption3__epLLG text-Charcoal text-justify">{inner}</div><div>no</div>'
    )
    rows = P.extract_reviews(frame(spark, page), P.SITE_ONE).collect()
    assert rows[1].comment == text and len(rows) == 4


def test_paragraphs_end_at_blocks_and_open_elements_give_nothing(spark):
    comments = "<p class='comment-card__text'>one<div>no</div></p><p class='comment-card__text'>two <b>more<p>no</p>"
    comments += "<div><p class='comment-card__text'>three</div><p class='comment-card__text'>never closed <b>x"
    rows = P.extract_reviews(frame(spark, f"<div class='comment-card__content'>{comments}"), P.SITE_TWO).collect()
    assert [r.comment for r in rows] == ["one", "two more", "three"]
    open_comment = PAGE_ONE.replace("<h1", "<!-- <h1")
    assert P.extract_reviews(frame(spark, open_comment), P.SITE_ONE).count() == 0


def test_csv_dialect(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text(
        'Page,Location,Room Type,Comment\n1,N/A,هتل,"say ""hi"", ok"\n2,x,null,N/A\n3,NA,none,\n4,x,-,"two\nlines"\n',
        encoding="utf-8",
    )
    rows = [tuple(r) for r in readers.read_reviews(spark, str(path)).orderBy("page").collect()]
    assert rows == [
        (1, None, "هتل", 'say "hi", ok'),
        (2, "x", None, None),
        (3, None, "none", None),
        (4, "x", "-", "two\nlines"),
    ]


def test_csv_keeps_sentiment_and_ids_are_stable(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("page,location,room_type,comment,Sentiment\n1,a,b,c,SAD\n2,a,b,d,HAPPY\n", encoding="utf-8")
    df = readers.with_review_id(readers.read_reviews(spark, str(path)))
    assert df.columns == ["page", "location", "room_type", "comment", "sentiment", "review_id"]
    first, again = df.orderBy("page").collect(), df.orderBy("page").collect()
    assert first == again and len({r.review_id for r in first}) == 2


def test_missing_input(spark):
    with pytest.raises(readers.MissingInput, match="no-such-file"):
        readers.read_reviews(spark, "/tmp/no-such-file.csv")


def test_word_lists(spark, tmp_path):
    path = tmp_path / "w.txt"
    path.write_text("از\n به \n\n و\t\nاز", encoding="utf-8")
    stripped = [r.word for r in readers.read_wordlist(spark, str(path)).collect()]
    raw = [r.word for r in readers.read_wordlist(spark, str(path), strip=False).collect()]
    assert stripped == ["از", "به", "و", "از"]
    assert raw == ["از", " به ", "", " و\t", "از"]


def test_page_urls_cover_the_whole_range(spark):
    urls = readers.page_urls(spark, "https://example.org/room/", 100, 110)
    assert urls.count() == 11
    assert urls.orderBy(F.desc("page_id")).first().url == "https://example.org/room/110"


def test_labelled(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text("id,label,comment\n1,SAD,بد\n2,HAPPY,خوب\n", encoding="utf-8")
    assert readers.read_labelled(spark, str(path), "csv").columns == ["comment", "label"]


def test_append_and_overwrite(spark, tmp_path):
    df, path = spark.range(3), str(tmp_path / "t")
    sinks.append_reviews(df, path)
    sinks.append_reviews(df, path)
    assert spark.read.parquet(path).count() == 6
    sinks.write_table(df, path)
    assert spark.read.parquet(path).count() == 3
    sinks.write_table(spark.createDataFrame([('a "b", c',)], "x string"), str(tmp_path / "c"), "csv")
    assert spark.read.csv(str(tmp_path / "c"), header=True, escape='"').first().x == 'a "b", c'


def test_topic_slices_are_replaced_one_by_one(spark, tmp_path):
    path, schema = str(tmp_path / "topics"), "sentiment string, topic string"
    sinks.write_topics(spark.createDataFrame([("HAPPY", "a"), ("SAD", "b")], schema), path)
    sinks.write_topics(spark.createDataFrame([("SAD", "c")], schema), path, replace=True)
    rows = {(r.sentiment, r.topic) for r in spark.read.parquet(path).collect()}
    assert rows == {("HAPPY", "a"), ("SAD", "c")}
    # One folder per slice, named by the escaped value, which tells null from a text of that name.
    assert sum(os.path.isdir(f"{path}/{f}") and "SAD" in f for f in os.listdir(path)) == 1
    assert [tuple(r) for r in sinks.read_topics(spark, path, sentiment="SAD").collect()] == [("SAD", "c")]
    sinks.write_topics(spark.createDataFrame([("SAD", "d")], schema), path)
    assert [tuple(r) for r in spark.read.parquet(path).select("sentiment", "topic").collect()] == [("SAD", "d")]


def test_sheets_and_rows(spark, capsys):
    topics = spark.createDataFrame([(0, "a b", 2.0)], "topic_id int, topic string, importance double")
    rows = sinks.topic_rows([("Happy", topics, {"k": 5}), ("Sad", topics, {})])
    assert [tuple(r) for r in rows.collect()] == [("Happy", 0, "a b", '{"k":"5"}'), ("Sad", 0, "a b", "{}")]
    named = sinks.with_sheet_key(spark.createDataFrame([("هتل", "SAD")], "room_type string, sentiment string"))
    assert named.first().sheet == "هتل_SAD"
    sinks.show_report(topics, [F.desc("importance")])
    assert "a b" in capsys.readouterr().out


def test_new_pages_are_appended_once(spark, tmp_path):
    source, out, name = str(tmp_path / "pages"), str(tmp_path / "out"), f"t{os.getpid()}"
    frame(spark, PAGE_TWO).write.parquet(source)
    append_new_pages(spark, source, P.SITE_TWO, out, name).awaitTermination()
    append_new_pages(spark, source, P.SITE_TWO, out, name).awaitTermination()
    assert spark.read.parquet(out).count() == 1
    frame(spark, BARE).write.mode("append").parquet(source)
    append_new_pages(spark, source, P.SITE_TWO, out, name).awaitTermination()
    assert sorted(r.comment for r in spark.read.parquet(out).collect()) == ["تنها", "خوب"]
