import random
import re

import pytest
from pyspark.sql import functions as F

from reviewlode.operators import blocks, topics


def _texts(spark):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    rows = [(i % 2, " ".join(draw.choices(words, weights=[30 // (j + 1) + 1 for j in range(30)], k=draw.randint(0, 12)))) for i in range(80)]
    return rows, topics._grouped_terms(spark.createDataFrame(rows, "group int, comment string"), None, (1, 3))


@pytest.mark.parametrize("limit", [0, topics.BROADCAST_ROWS])
def test_sequences_are_counted_whole_if_their_words_are_frequent(spark, limit):
    """Every term in enough texts has its count, and sequences with a rarer word were not counted, if words can be sent."""
    rows, texts = _texts(spark)
    low = 6

    def enough(found):
        return found.where(F.col("df") >= low).select("group", "term")

    found = {(r.group, r.term): r.df for r in topics._frequencies(texts, enough, (1, 3), limit).collect()}
    wanted = {}
    for group, text in rows:
        w = text.split()
        for term in {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}:
            wanted[group, term] = wanted.get((group, term), 0) + 1
    assert {k: v for k, v in found.items() if v >= low} == {k: v for k, v in wanted.items() if v >= low}
    rare = [term for group, term in found if any(wanted[group, w] < low for w in term.split())]
    assert bool(rare) == (limit == 0)


def test_counts_do_not_depend_on_how_terms_are_sent(spark):
    """The same rows of counts, whether a text's other terms are left out where it lies or by a join of all counts."""
    _, texts = _texts(spark)
    chosen = texts.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("term").alias("df")).where("df >= 3")
    both = [topics._counted(texts, chosen, limit).rows.collect() for limit in (0, topics.BROADCAST_ROWS)]
    assert both[0] and sorted(map(str, both[0])) == sorted(map(str, both[1]))


def test_texts_are_dealt_to_blocks_once(spark):
    """The words of blocks and the lookup read one shuffle of the texts; before, each had its own."""
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["c", None])], "k long, words array<string>")
    dealt = blocks.in_blocks(df, F.size("words"), 4)
    held = blocks.words_of_blocks(dealt, "words")
    assert sorted(r.token for r in held.collect()) == ["a", "b", "c"]
    entries = spark.createDataFrame([("a", 1)], "token string, id int")
    found = blocks.lookup_words(dealt, held, entries, [F.col("k"), F.col("words")], lambda x, y: x.select(["k"]), "k long")
    assert sorted(r.k for r in found.collect()) == [1, 2]
    plan = found._jdf.queryExecution().executedPlan().toString()
    read = {tuple(c.split("#")[0] for c in columns.split(",")) for columns in re.findall(r"FileScan parquet \[(.*?)\]", plan)}
    assert read == {("k", "words")}
