"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees over statistics of labelled documents give conjunctions of thresholds (every path from a
root to an inner node or leaf). A logistic regression with an L1 penalty over these rules keeps few of
them. The result is one column expression, so scoring needs no model on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlode.llm.common import WORD, doc_hash, free
from reviewlode.session import land

# Labelled rows that a fit may read: those with the smallest hashes of their id.
TRAINING_ROWS = 8_000
TREES, DEPTH = 24, 3
PENALTY = 0.002
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

Condition = tuple[str, bool, float]  # statistic, whether it is above, threshold


@dataclass(frozen=True)
class RuleModel:
    """``score = 1 / (1 + exp(-(intercept + sum of the weights of the rules that hold)))``."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self, statistics: dict[str, Column]) -> Column:
        """The score as a column expression over the statistics."""
        margin = F.lit(self.intercept)
        for conditions, weight in self.rules:
            margin = margin + F.when(_holds(conditions, statistics), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-margin))


def _holds(conditions: tuple[Condition, ...], statistics: dict[str, Column]) -> Column:
    tests = [statistics[n] > at if above else statistics[n] <= at for n, above, at in conditions]
    return reduce(lambda a, b: a & b, tests)


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, each defined for null and empty texts too."""
    text = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    counts = F.transform(
        F.array(found),
        lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("kinds")),
    )[0]
    letters = F.length(F.translate(text, BLANKS, ""))

    def marks(characters: str) -> Column:
        return F.length(text) - F.length(F.translate(text, characters, ""))

    lines = 1 + marks("\n")
    return {
        "counts": counts,
        "letters": letters.cast("double"),
        "symbols": marks("#*$%&<>").cast("double"),
        "bars": marks("|").cast("double"),
        "bangs": marks("!").cast("double"),
        "stops": marks(".,;:?").cast("double"),
        "digits": marks("0123456789").cast("double"),
        "capitals": marks(UPPER).cast("double"),
        "lines": lines.cast("double"),
    }


FEATURES = (
    "log_words",
    "word_length",
    "kinds",
    "symbols",
    "bars",
    "bangs",
    "stops",
    "digits",
    "capitals",
    "line_words",
)


def with_features(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with one column per feature, and the columns' names."""
    raw = statistics(F.col(text))
    step = {n: free(docs.columns, f"raw_{n}") for n in raw}
    names = {n: free(docs.columns, f"feature_{n}") for n in FEATURES}
    measured = docs.withColumns({step[n]: c for n, c in raw.items()})
    n = F.col(step["counts"])["n"].cast("double")
    per_word = F.greatest(n, F.lit(1.0))
    made = {
        "log_words": F.log1p(n),
        "word_length": F.col(step["letters"]) / per_word,
        # Longer texts repeat more words by nature; the power levels that out.
        "kinds": F.col(step["counts"])["kinds"] / F.pow(per_word, F.lit(0.8)),
        "symbols": F.col(step["symbols"]) / per_word,
        "bars": F.col(step["bars"]) / per_word,
        "bangs": F.col(step["bangs"]) / per_word,
        "stops": F.col(step["stops"]) / per_word,
        "digits": F.col(step["digits"]) / F.greatest(F.col(step["letters"]), F.lit(1.0)),
        "capitals": F.col(step["capitals"]) / F.greatest(F.col(step["letters"]), F.lit(1.0)),
        "line_words": n / F.col(step["lines"]),
    }
    return measured.withColumns({names[k]: c for k, c in made.items()}).drop(*step.values()), names


def _paths(node: object, names: list[str], path: tuple[Condition, ...] = ()) -> Iterator[tuple[Condition, ...]]:
    if path:
        yield path
    if node.getClass().getSimpleName() == "InternalNode":
        name, at = names[node.split().featureIndex()], float(node.split().threshold())
        yield from _paths(node.leftChild(), names, (*path, (name, False, at)))
        yield from _paths(node.rightChild(), names, (*path, (name, True, at)))


def fit(labelled: DataFrame, features: list[str], label: str) -> RuleModel:
    """Learn from rows with a 0/1 label; rows are few (``TRAINING_ROWS``) and stored.

    Without rows the score is one half everywhere; with one kind of label it is that label's smoothed share.
    """
    row = labelled.agg(F.count(label), F.sum(label)).first()
    n, ones = row[0], int(row[1] or 0)
    if ones in (0, n):
        share = (ones + 1) / (n + 2)
        return RuleModel(math.log(share / (1 - share)), ())
    data = labelled.select(F.col(label).cast("double").alias("y"), array_to_vector(F.array(*features)).alias("x"))
    data = land(data.coalesce(4), "training")
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="y", numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="onethird"
    ).fit(data)
    found = {tuple(p) for tree in forest.trees for p in _paths(tree._call_java("rootNode"), features)}
    rules = sorted(found)
    columns = {name: F.col(name) for name in features}
    fired = F.array(*[_holds(r, columns).cast("double") for r in rules])
    binary = labelled.select(F.col(label).cast("double").alias("y"), array_to_vector(fired).alias("x"))
    binary = land(binary.coalesce(4), "rules")
    lasso = LogisticRegression(
        featuresCol="x", labelCol="y", elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=60
    ).fit(binary)
    weights = zip(rules, lasso.coefficients.toArray().tolist(), strict=True)
    return RuleModel(float(lasso.intercept), tuple((r, w) for r, w in weights if w != 0.0))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> RuleModel:
    """Learn from labelled documents whose crc32(id) mod 3 is not 1, at most ``TRAINING_ROWS`` of them.

    The rows are those with the smallest hashes, found on the labels alone; an id with several labels
    counts as its smallest, labels other than 0 and 1 and null ids are left out.
    """
    given = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (F.pmod(doc_hash(F.col(key)), F.lit(3)) != 1))
    given = given.groupBy(F.col(key).alias("label_id")).agg(F.min(label).alias("label_value"))
    given = land(given.orderBy(F.xxhash64("label_id"), "label_id").limit(TRAINING_ROWS), "labels")
    mine = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    mine = mine.join(F.broadcast(given), mine["id"] == given["label_id"]).select("text", "label_value")
    measured, names = with_features(mine)
    features = [names[n] for n in FEATURES]
    stored = land(measured.select(*features, "label_value"), "features")
    return fit(stored.toDF(*FEATURES, "label_value"), list(FEATURES), "label_value")


def classify(docs: DataFrame, model: RuleModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from one half on) added.

    Only the text is read. Null and empty texts get the score of their zero statistics; equal texts get
    equal scores. A new column whose name ``docs`` has already gets underscores.
    """
    measured, names = with_features(docs, text)
    score, predicted = (free(docs.columns, n) for n in ("score", "predicted"))
    scored = measured.withColumn(score, model.score({n: F.col(c) for n, c in names.items()}))
    scored = scored.withColumn(predicted, (F.col(score) >= 0.5).cast("int"))
    return scored.drop(*names.values())


def keep_good(docs: DataFrame, model: RuleModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are predicted good, with their columns."""
    return classify(docs, model, text).where(F.col(free(docs.columns, "predicted")) == 1).select(*docs.columns)
