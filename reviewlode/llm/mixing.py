"""Mixing sources to target weights by Pareto order sampling, in whole copies of documents.

Word targets per source follow its weight, up to ``most`` times the source's own words; what a full source
leaves is shared again by weight. Within a source a document's expected copies grow with the logarithm of
its length, scaled so that they add up to the target. The whole part of that number is taken for certain.
The rest, a probability ``p``, goes through an order sample: documents are ranked by the odds of a hashed
uniform number divided by the odds of ``p``, and the lowest ranks are taken up to the words still missing.

All work is DataFrame functions. No source is sorted as a whole: ranks are counted in ``BINS`` bins, and only
the bin that holds the end of the sample is ordered. Reruns give the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlode.llm.common import free, n_words, small
from reviewlode.session import land

MOST = 3
WEIGHTS = (1, 2, 3)
BINS = 4096


def _fill(items: DataFrame, groups: list[str], order: list[str], weight: str, full: str, total: str) -> DataFrame:
    """``items`` with ``level``: weight times level, cut at ``full``, adds up to ``total`` in each group.

    Items are few per group (sources of a corpus, length classes of a source). The item that fills first
    is the one with the smallest ``full`` per ``weight``; beyond the last one that fills, the level is what
    is left divided by the weights that are left.
    """
    rank = [(F.col(full) / F.col(weight)).asc(), *[F.col(c).asc_nulls_last() for c in order]]
    before = Window.partitionBy(*groups).orderBy(*rank).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*groups).orderBy(*rank).rowsBetween(0, Window.unboundedFollowing)
    used = F.coalesce(F.sum(full).over(before), F.lit(0.0))
    items = items.withColumn("trial", (F.col(total) - used) / F.sum(weight).over(after))
    # The first item that does not fill has the level; later trials take it for full and are lower.
    fits = F.when(F.col("trial") * F.col(weight) < F.col(full), F.col("trial"))
    level = F.max(fits).over(Window.partitionBy(*groups))
    return items.withColumn("level", level).drop("trial")


def _cut(weight: str, full: str) -> Column:
    """Weight times level, or ``full`` where every item of the group is full."""
    return F.when(F.col("level").isNull(), F.col(full)).otherwise(F.least(F.col("level") * F.col(weight), F.col(full)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size); weights repeat over sources by code point, null last."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    at = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    given = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), at).cast("double"))
    given = given.withColumn("full", F.col("source_size") * F.lit(float(most)))
    given = given.withColumn("everything", F.lit(0)).withColumn(
        "total", F.sum("source_size").over(Window.partitionBy("everything")).cast("double")
    )
    filled = _fill(given, ["everything"], ["source"], "weight", "full", "total")
    return filled.select("source", "source_size", _cut("weight", "full").alias("target"))


def _plans(sizes: DataFrame, goals: DataFrame, most: int) -> DataFrame:
    """(source, step, copies): expected copies of a document by source and length class."""
    steps = sizes.where("size > 0").groupBy("source", "step").agg(F.sum("size").alias("words"))
    steps = steps.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    steps = steps.withColumn("weight", (F.col("step") + 1.0) * F.col("words"))
    steps = steps.withColumn("full", F.col("words") * F.lit(float(most)))
    filled = _fill(steps, ["source"], ["step"], "weight", "full", "target")
    return filled.select("source", "step", (_cut("weight", "full") / F.col("words")).alias("copies"))


def _ranked(docs: DataFrame, plans: DataFrame, on: tuple[str, str], key: str, text: Column, made: dict[str, str]) -> DataFrame:
    """``docs`` with whole copies and the rank of the rest; smaller ranks go first."""
    names = [free(docs.columns, n) for n in ("p_source", "p_step", "p_copies")]
    of, step, number = map(F.col, names)
    same = F.col(on[0]).eqNullSafe(of) & (F.col(on[1]) == step)
    joined = docs.join(small(plans.toDF(*names)), same, "left")
    copies = F.coalesce(number, F.lit(0.0))
    # Copies this near a whole number are whole; their odds would be infinite.
    whole = F.floor(copies + 1e-9)
    rest = F.greatest(copies - whole, F.lit(0.0))
    uniform = (F.pmod(F.xxhash64(F.col(key), text, F.lit(20)), F.lit(2**52)) + 0.5) / float(2**52)
    rank = F.when(rest > 0, F.log(uniform / (1 - uniform)) - F.log(rest / (1 - rest)))
    joined = joined.withColumn(made["whole"], whole.cast("long")).withColumn(made["rank"], rank)
    return joined.drop(*names)


def _ends(ranked: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, last): the largest rank that the sample of a source takes, null for none.

    The document at the end is taken if that brings the words nearer to the target. Equal ranks, as of
    repeated rows, share their fate. Taken words never drop below the whole copies.
    """
    certain = ranked.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    left = certain.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    left = left.select("source", (F.col("target") - F.col("certain")).alias("missing"))
    # The logistic of a rank lies in (0, 1), which gives bins of bounded number.
    place = 1.0 / (1.0 + F.exp(-F.col("rank")))
    rows = ranked.where("rank is not null and size > 0").withColumn("bin", F.floor(place * BINS).cast("int"))
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    so_far = Window.partitionBy("source").orderBy("bin")
    bins = bins.withColumn("upto", F.sum("words").over(so_far)).withColumn("start", F.col("upto") - F.col("words"))
    mine = left.toDF("of", "missing")
    # Bins wholly inside the sample, and the one that holds its end.
    bins = bins.join(mine, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    edge = bins.where("start < missing and upto > missing").select(F.col("source").alias("of"), F.col("bin").alias("edge"), "start", "missing")
    inner = bins.where("upto <= missing").groupBy("source").agg(F.max("bin").alias("inner"))
    inside = rows.join(small(edge), F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("edge")))
    ties = inside.groupBy("source", "start", "missing", "rank").agg(F.sum("size").alias("words"))
    upto = F.col("start") + F.sum("words").over(Window.partitionBy("source").orderBy("rank"))
    ties = ties.withColumn("upto", upto)
    # The end is the last rank whose middle lies inside.
    last = ties.where("upto - words / 2 <= missing").groupBy("source").agg(F.max("rank").alias("last"))
    whole_bins = inner.withColumn("all_below", (F.col("inner") + 1) / F.lit(float(BINS)))
    out = left.select("source").join(last.withColumnRenamed("source", "l"), F.col("source").eqNullSafe(F.col("l")), "left")
    out = out.join(whole_bins.withColumnRenamed("source", "w"), F.col("source").eqNullSafe(F.col("w")), "left")
    return out.select("source", "last", F.coalesce("all_below", F.lit(0.0)).alias("below"))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` added.

    ``size`` counts words (null text: 0), ``copies`` (0 to ``most``) says how often the mix holds the row, and
    ``taken`` is their product. Empty documents are never taken. A null source is a source, the last one.
    Repeated rows have the same copies. New columns whose names ``docs`` has already get underscores.
    """
    made = {n: free(docs.columns, n) for n in ("size", "source_size", "target", "copies", "taken", "step", "whole", "rank")}
    sized = docs.withColumn(made["size"], n_words(F.col(text)))
    sized = sized.withColumn(made["step"], F.floor(F.log2(F.col(made["size"]) + 1)).cast("int"))
    print_of = F.xxhash64(F.col(text))
    sizes = sized.select(
        F.col(source).alias("source"), F.col(made["size"]).alias("size"), F.col(made["step"]).alias("step"),
        F.col(key).alias("key"), print_of.alias("print"),
    )
    sizes = land(sizes, "sizes")
    goals = land(targets(sizes, weights, most), "targets")
    plans = land(_plans(sizes, goals, most), "plans")
    own = {"whole": "whole", "rank": "rank"}
    ranked = land(_ranked(sizes, plans, ("source", "step"), "key", F.col("print"), own), "ranks")
    ends = land(_ends(ranked, goals), "ends")
    mark = free(sized.columns, "p_print")
    out = _ranked(sized.withColumn(mark, print_of), plans, (source, made["step"]), key, F.col(mark), made).drop(mark)
    facts = goals.join(ends.withColumnRenamed("source", "e"), F.col("source").eqNullSafe(F.col("e")), "left").drop("e")
    names = [free(out.columns, n) for n in ("p_source", "p_size", "p_target", "p_last", "p_below")]
    of, of_size, goal, last, upto = map(F.col, names)
    out = out.join(small(facts.toDF(*names)), F.col(source).eqNullSafe(of), "left")
    rank = F.col(made["rank"])
    below = F.floor(1.0 / (1.0 + F.exp(-rank)) * BINS) < upto * BINS
    drawn = F.coalesce(below, F.lit(False)) | F.coalesce(rank <= last, F.lit(False))
    copies = F.when(F.col(made["size"]) > 0, F.col(made["whole"]) + drawn.cast("long")).otherwise(F.lit(0).cast("long"))
    out = out.withColumn(made["copies"], copies)
    out = out.withColumn(made["taken"], F.col(made["copies"]) * F.col(made["size"]))
    out = out.withColumn(made["source_size"], of_size).withColumn(made["target"], goal)
    return out.select(*docs.columns, *[made[n] for n in ("size", "source_size", "target", "copies", "taken")])


def mixed_rows(docs: DataFrame, **options: str) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    made = free(docs.columns, "copies")
    out = mix(docs, **options).where(F.col(made) > 0)
    turn = free(out.columns, "turn")
    return out.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(made)))).select(*docs.columns)
