import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewlode.llm import quality_rules, queries, rule_classifier

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(5)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts_match_plain_ones(spark, odd_docs):
    texts = [
        "a b c d e a b c d e", "a a a a a a", "a b c d e f", "x\nx\n\n \n x\nx", "p q r s t u p q r s t v p q r s t",
        "one ## two $$ <b> | & 100%", "a b c d a b c d a b c d", "ä Ö ü \U0001f600  x", "",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = docs.union(odd_docs.select("doc_id", "text"))
    names = quality_rules.base_columns(F.col("text"))
    for row in docs.select("text", *[c.alias(n) for n, c in names.items()]).collect():
        assert tuple(row[n] for n in names) == plain_counts(row.text), row.text[:60]


def plain_fence(rule, values, start, part):
    """The fence of a group's values; a sketch of so few is exact: the smallest value with this share at or below it."""
    values = sorted(values)
    low, middle, high = (values[max(0, -(-tenths * len(values) // 10) - 1)] for tenths in (1, 5, 9))
    upper = max(rule.step, min(2 * rule.step, high - middle))
    own = middle + quality_rules.REACH * max(middle - low, upper)
    weight = len(values) / (len(values) + quality_rules.FULL)
    if part:
        weight *= min(1.0, (start / own) ** 2)
    return start + weight * (own - start)


def test_a_lone_junk_document_fails(make_docs):
    clean = [(" ".join(f"word{i}x{j}" for j in range(30)), "en", "plain") for i in range(20)]
    junk = [(" ".join(f"a{j}" for j in range(30)) + " ##### ####" * 7, lang, "alone") for lang in ("en", "xx", None)]
    kept = quality_rules.verdicts(make_docs(clean + junk)).select("source", "base_failed", "kept").collect()
    assert all(r.kept == (r.source == "plain") for r in kept) and not any(r.base_failed for r in kept if r.source == "plain")


def test_verdict_follows_the_fences(spark):
    rows = {r.doc_id: r for r in queries.op6_quality_rules(spark, SF).collect()}
    texts = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(rows) == set(texts)
    for i, row in rows.items():
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == plain_counts(texts[i].text)
        assert row.base_failed == (row.n_words < 10 or 100 * row.n_repeat_words > 20 * row.n_words)
    inside = {i: not r.base_failed for i, r in rows.items()}
    for rule in quality_rules.RULES:
        levels = [{}, {}, {}]
        for i, row in rows.items():
            for level, key in zip(levels, [(), (texts[i].lang,), (texts[i].lang, texts[i].source)]):
                level.setdefault(key, []).append(row[rule.name])
        fences = {}
        for depth, level in enumerate(levels):
            for key, values in level.items():
                start = fences[key[:-1]] if depth else rule.floor
                fences[key] = plain_fence(rule, values, start, depth > 1)
        for i, row in rows.items():
            inside[i] &= row[rule.name] <= fences[texts[i].lang, texts[i].source]
    assert inside == {i: r.kept for i, r in rows.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [rows[i].kept for i in labels if labels[i] == 1 and not rows[i].base_failed]
    assert sum(good) >= 0.99 * len(good)
    assert not any(rows[i].kept for i in labels if labels[i] == 0 and rows[i].symbol_ratio > 0.9)


def test_rules_on_odd_rows(odd_docs, clashing, no_docs):
    kept = quality_rules.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == {4: 2, 5: 1, None: 1}
    assert quality_rules.keep_good(clashing).count() == 4
    judged = quality_rules.apply_rules(clashing)
    assert judged.where("kept = 7 and kept_").count() == 4
    assert quality_rules.verdicts(no_docs).count() == 0 and quality_rules.keep_good(no_docs).count() == 0


def test_sketches_merge(make_docs):
    docs = make_docs([("word " * (10 + i % 7), "en" if i % 3 else None, "s") for i in range(60)])
    measured, names = quality_rules.measure(docs)
    on = ["lang", "source"]
    parts = [quality_rules.sketches(measured.where(f"doc_id % 2 = {i}"), names, on) for i in (0, 1)]
    merged = quality_rules.limits(quality_rules.merge_sketches(parts, on), on)
    whole = quality_rules.limits(quality_rules.sketches(measured, names, on), on)
    assert sorted(map(str, merged.collect())) == sorted(map(str, whole.collect()))


def test_groups_set_their_own_thresholds(spark, make_docs):
    rows = []
    for i in range(150):
        words = [f"{'abcdefghij'[(i + j) % 10]}{i}w{j}" for j in range(40)]
        tags = " #" * (2 + i % 5)
        rows += [(" ".join(words), "en", "plain"), (" ".join(words) + tags, "en", "tagged")]
        rows.append((" ".join(words) + " #" * 100, "en", "junk"))
        rows.append((" ".join(f"long{w}word" for w in words), "de", "plain"))
    docs = make_docs(rows)
    measured, names = quality_rules.measure(docs)
    on = ["lang", "source"]
    fences = {(r.lang, r.source): r for r in quality_rules.limits(quality_rules.sketches(measured, names, on), on).collect()}
    floors = {r.name: r.floor for r in quality_rules.RULES}
    plain, tagged, german = fences["en", "plain"], fences["en", "tagged"], fences["de", "plain"]
    assert plain.symbol_ratio < tagged.symbol_ratio and plain.word_length < floors["word_length"] < german.word_length
    assert all(f.bang_ratio < floors["bang_ratio"] for f in fences.values())
    assert not any(r.kept for r in quality_rules.verdicts(docs).where("source = 'junk'").collect())


def test_thresholds_follow_the_given_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    measured, names = quality_rules.measure(docs)
    sketched = quality_rules.sketches(measured, names, ["lang"])
    fences = quality_rules.limits(sketched, ["lang"]).collect()
    for rule in quality_rules.RULES:
        assert len({round(r[rule.name], 9) for r in fences}) == len(fences) == 4
    assert all(r.word_length < 15 and r.symbol_ratio < 0.25 for r in fences)


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    return rule_classifier.train(docs, labels)


def test_held_out_documents_are_told_apart(spark, model):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    scored = rule_classifier.classify(docs, model).join(labels, "doc_id").collect()
    held_out = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held_out) > 80
    assert sum(r.predicted == r.quality for r in held_out) >= 0.95 * len(held_out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    assert 1 <= len(model.rules) <= 200


def test_classifier_reads_the_text_only(model, odd_docs, clashing, no_docs):
    plain = rule_classifier.classify(odd_docs, model)
    assert plain.columns == [*odd_docs.columns, "score", "predicted"]
    moved = odd_docs.withColumns({"doc_id": F.lit(1), "lang": F.lit("x"), "source": F.lit(None).cast("string")})
    scores = sorted(r.score for r in plain.collect())
    assert scores == sorted(r.score for r in rule_classifier.classify(moved, model).collect())
    assert scores == sorted(r.score_ for r in rule_classifier.classify(clashing, model).collect())
    assert rule_classifier.keep_good(clashing, model).columns == clashing.columns
    assert rule_classifier.classify(no_docs, model).count() == 0


def test_without_two_kinds_of_labels(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert rule_classifier.train(odd_docs, none).intercept == 0.0
    ones = spark.createDataFrame([(i, 1) for i in range(8)] + [(None, 1), (3, None), (2, 9)], "doc_id long, quality int")
    model = rule_classifier.train(odd_docs, ones)
    assert model.rules == () and model.intercept > 0
