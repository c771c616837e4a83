"""Quality rules whose thresholds follow the data: one fence per statistic, language and source.

Each (language, source) keeps a mergeable quantile sketch of every statistic. Sketches of several batches
merge into those of the whole, so thresholds can be maintained without reading old texts.
A fence lies ``REACH`` spreads above the median. The spread is the way from the lowest tenth to the median, or,
if that is more, from the median to the highest tenth, the latter taken as one ``step`` at least and two at most,
so up to half of a group may be bad before its fence moves far. The fence of all rows starts from ``floor``, that of
a language from all rows', that of a group from its language's; ``FULL`` rows carry half the weight, so small groups
follow their language, and a group whose own fence lies above its language's counts less the farther off it is.
All work is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlode.llm.common import free, n_words, small, words
from reviewlode.session import land

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5
REACH = 4.0
SKETCH_SIZE = 4000
# Rows at which a group's own fence weighs as much as what it starts from.
FULL = 100


@dataclass(frozen=True)
class Rule:
    """A statistic, the fence that few rows start from, and the least spread above a median."""

    name: str
    value: Callable[[Column, dict[str, Column]], Column]
    floor: float
    step: float


def _per_word(part: Column, base: dict[str, Column]) -> Column:
    return part / F.greatest(base["n_words"], F.lit(1))


def _without(text: Column, marks: str) -> Column:
    return F.length(text) - F.length(F.translate(text, marks, ""))


RULES = [
    Rule("symbol_ratio", lambda t, b: _per_word(b["n_symbols"], b), 0.25, 0.03),
    Rule("bang_ratio", lambda t, b: _per_word(_without(t, "!?"), b), 0.35, 0.04),
    Rule("upper_ratio", lambda t, b: F.regexp_count(t, F.lit(r"\p{Lu}")) / F.greatest(b["word_chars"], F.lit(1)), 0.4, 0.025),
    Rule("line_ratio", lambda t, b: _per_word(b["n_dup_lines"], b), 0.08, 0.01),
    Rule("repeat_ratio", lambda t, b: _per_word(b["n_repeat_words"], b), 0.15, 0.03),
    Rule("word_length", lambda t, b: _per_word(b["word_chars"], b), 15.0, 0.5),
]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once per row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _repeated(grams: Column) -> Column:
    """Words covered by windows that occur twice or more, from the windows' hashes in order."""

    def covered(pairs: Column) -> Column:
        def same(at: Column) -> Column:
            return F.get(pairs, at)["g"]

        twice = F.filter(pairs, lambda x, i: same(i - 1).eqNullSafe(x["g"]) | same(i + 1).eqNullSafe(x["g"]))
        places = F.array_sort(F.transform(twice, lambda x: x["p"]))
        return _let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            ),
        )

    pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), _let(pairs, covered)).otherwise(F.lit(0).cast("long"))


def repeat_words(text: Column) -> Column:
    """Words in ``WINDOW``-word windows that the text holds twice or more, first places included."""

    def windows(hashes: Column) -> Column:
        def one(i: Column) -> Column:
            return F.xxhash64(*[F.get(hashes, i + j) for j in range(WINDOW)])

        return F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), one)

    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    return _let(
        hashes,
        lambda h: F.when(F.size(h) <= WINDOW, F.lit(0).cast("long")).otherwise(_let(windows(h), _repeated)),
    )


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    full = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)
    return _let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def base_columns(text: Column) -> dict[str, Column]:
    """The counts every rule builds on; 0 for null and empty texts."""
    text = F.coalesce(text, F.lit(""))
    return {
        "n_words": n_words(text),
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": _without(text, SYMBOLS).cast("long"),
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": repeat_words(text),
    }


def measure(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all counts and statistics as new columns, and the names these got."""
    names = {n: free(docs.columns, n) for n in [*base_columns(F.lit("")), *(r.name for r in RULES)]}
    counted = docs.withColumns({names[n]: c for n, c in base_columns(F.col(text)).items()})
    base = {n: F.col(names[n]) for n in base_columns(F.lit(""))}
    whole = F.coalesce(F.col(text), F.lit(""))
    return counted.withColumns({names[r.name]: r.value(whole, base).cast("double") for r in RULES}), names


def sketches(measured: DataFrame, names: dict[str, str], groups: list[str]) -> DataFrame:
    """A quantile sketch of every statistic per group."""
    parts = [F.kll_sketch_agg_double(names[r.name], F.lit(SKETCH_SIZE)).alias(r.name) for r in RULES]
    return measured.groupBy(*groups).agg(*parts)


def merge_sketches(parts: list[DataFrame], groups: list[str]) -> DataFrame:
    """Sketches of several batches as sketches of their union."""
    merged = [F.kll_merge_agg_double(r.name, F.lit(SKETCH_SIZE)).alias(r.name) for r in RULES]
    return reduce(DataFrame.unionByName, parts).groupBy(*groups).agg(*merged)


def limits(sketched: DataFrame, groups: list[str]) -> DataFrame:
    """The upper fence of every statistic per group, in columns named as the statistics.

    The first group is held against all rows, every further one against the groups it is part of.
    """
    stored = land(sketched, "sketches")
    above: DataFrame | None = None
    for depth in range(len(groups) + 1):
        on = groups[:depth]
        level = stored if depth == len(groups) else merge_sketches([stored], on)
        if above is None:
            start = {r.name: F.lit(r.floor) for r in RULES}
        else:
            marks = {c: f"above_{i}" for i, c in enumerate(above.columns)}
            outer = small(above.select(*[F.col(c).alias(m) for c, m in marks.items()]))
            same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(marks[g])) for g in on[:-1]], F.lit(True))
            level = level.join(outer, same, "left")
            start = {r.name: F.col(marks[r.name]) for r in RULES}
        above = level.select(*on, *[_fence(r, start[r.name], depth > 1).alias(r.name) for r in RULES])
    return above


def _fence(rule: Rule, start: Column, part: bool) -> Column:
    """The fence of a sketch's rows, moved from ``start`` by their number."""
    n = F.kll_sketch_get_n_double(rule.name)
    low, middle, high = (F.kll_sketch_get_quantile_double(rule.name, F.lit(q)) for q in (0.1, 0.5, 0.9))
    upper = F.greatest(F.lit(rule.step), F.least(F.lit(2 * rule.step), high - middle))
    own = middle + REACH * F.greatest(middle - low, upper)
    weight = n / (n + F.lit(FULL))
    if part:
        weight = weight * F.least(F.lit(1.0), F.pow(start / own, F.lit(2.0)))
    return F.when(n > 0, start + weight * (own - start)).otherwise(start)


def judge(measured: DataFrame, names: dict[str, str], fences: DataFrame, groups: list[str]) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept`` (names as ``names`` has them)."""
    marks = {c: free([*measured.columns, *fences.columns], f"fence_{c}") for c in fences.columns}
    fences = small(fences.select(*[F.col(c).alias(m) for c, m in marks.items()]))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(marks[g])) for g in groups])
    count, repeats = F.col(names["n_words"]), F.col(names["n_repeat_words"])
    failed = (count < 10) | (100 * repeats > 20 * count)
    inside = reduce(lambda a, b: a & b, [F.col(names[r.name]) <= F.col(marks[r.name]) for r in RULES])
    joined = measured.join(fences, same, "left").withColumn(names["base_failed"], failed)
    kept = ~F.col(names["base_failed"]) & F.coalesce(inside, F.lit(True))
    return joined.withColumn(names["kept"], kept).drop(*marks.values())


def apply_rules(docs: DataFrame, text: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``docs`` with counts, statistics, ``base_failed`` and ``kept`` added.

    Thresholds come from sketches over all rows. Null texts count as empty, and empty ones fail the base
    rule; a null language or source is a group of its own. Repeated rows get the same verdict. A new
    column whose name ``docs`` has already gets underscores. An empty table gives an empty one.
    """
    on = list(dict.fromkeys(groups))
    measured, names = measure(docs, text)
    numbers = land(measured.select(*on, *[names[r.name] for r in RULES]), "statistics")
    names |= {n: free(docs.columns, n) for n in ("base_failed", "kept")}
    return judge(measured, names, limits(sketches(numbers, names, on), on), on)


def verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """As ``apply_rules``, with the text measured once: (key, groups, counts, statistics, verdict)."""
    on = list(dict.fromkeys(groups))
    measured, names = measure(docs.select(key, text, *[g for g in on if g not in (key, text)]), text)
    stored = land(measured.drop(*[c for c in (text,) if c not in on]), "statistics")
    names |= {n: free(stored.columns, n) for n in ("base_failed", "kept")}
    return judge(stored, names, limits(sketches(stored, names, on), on), on)


def keep_good(docs: DataFrame, text: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns."""
    mark = free(docs.columns, "kept")
    return apply_rules(docs, text, groups).where(F.col(mark)).select(*docs.columns)
