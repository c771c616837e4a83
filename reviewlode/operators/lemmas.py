"""Lemmas and tags of words that a lexicon does not hold, learned from the endings of those it holds.

An entry's lemma is its token with an ending cut off and another one put on. Every ending that holds the cut votes for
that edit and for the entry's tag. An unseen word takes the edit of its longest ending that has a rule. Rules and words are
tables; a word is looked up once, however often it occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlode.functions import text as X
from reviewlode.operators.skew import lookup_join
from reviewlode.operators.tokens import best_entries
from reviewlode.session import land

# Longest ending, in characters, and the words that an ending must have.
LONGEST, LEAST = 5, 2


def _endings(df: DataFrame, first: str, longest: int) -> DataFrame:
    """``df`` with ``ending``: one row per ending of ``token`` from ``first`` characters on; one character stays before it."""
    last = f"least({longest}, length(token) - 1)"
    rows = df.where(F.expr(f"{first} <= {last}"))
    return rows.withColumn("_n", F.explode(F.expr(f"sequence({first}, {last})"))).withColumn("ending", F.expr("right(token, _n)"))


def ending_rules(lexicon: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """``ending, cut, added, upos, words, total``: the commonest edit and tag of every ending of ``least`` words or more.

    ``cut`` characters go and ``added`` is put on. A word counts once, with its most frequent entry;
    entries without a lemma or a tag do not count.
    """
    entries = best_entries(lexicon).where("token IS NOT NULL AND lemma IS NOT NULL AND upos IS NOT NULL")
    same = "size(filter(sequence(1, greatest(1, least(length(token), length(lemma)))), i -> left(token, i) = left(lemma, i)))"
    edits = entries.withColumn("_same", F.expr(same)).select(
        "token", "upos", F.expr("length(token) - _same").alias("cut"), F.expr("substring(lemma, _same + 1)").alias("added")
    )
    votes = _endings(edits, "greatest(cut, 1)", longest).groupBy("ending", "cut", "added", "upos")
    best = F.max(F.struct("words", "added", "cut", "upos")).alias("best")
    rules = votes.agg(F.count(F.lit(1)).alias("words")).groupBy("ending").agg(best, F.sum("words").alias("total"))
    return rules.where(F.col("total") >= least).select("ending", "best.cut", "best.added", "best.upos", "best.words", "total")


def guess(words: DataFrame, rules: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``token, lemma, upos`` of the distinct ``words`` (token) that have an ending with a rule."""
    endings = _endings(words.select("token").distinct(), "1", longest)
    found = lookup_join(endings, rules.select("ending", "cut", "added", "upos"), "ending", "inner", spread_by=["token"])
    best = found.groupBy("token").agg(F.max(F.struct("_n", "cut", "added", "upos")).alias("best"))
    lemma = F.expr("concat(left(token, length(token) - best.cut), best.added)").alias("lemma")
    return best.select("token", lemma, "best.upos")


def unseen_words(df: DataFrame, lexicon: DataFrame, column: str) -> DataFrame:
    """``token``: the distinct words of a text column, marks and numbers aside, that the lexicon does not hold."""
    tokens = df.select(F.explode(F.transform(X.tokenise(F.col(column)), lambda t: t["text"])).alias("token")).distinct()
    return tokens.where(F.col("token").rlike(r"\A\p{L}")).join(lexicon.select("token").distinct(), "token", "left_anti")


def with_guesses(df: DataFrame, lexicon: DataFrame, column: str = "comment", rules: DataFrame | None = None) -> DataFrame:
    """A lexicon for the texts of ``df``: the given entries, and guesses for all other words that have a rule."""
    rules = land(ending_rules(lexicon), "rules") if rules is None else rules
    entries = lexicon.select("token", "lemma", "upos", "freq")
    guessed = guess(unseen_words(df, lexicon, column), rules)
    return land(entries.union(guessed.withColumn("freq", F.lit(0).cast("bigint"))), "lexicon")
