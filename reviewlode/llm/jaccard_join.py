"""Join of documents whose word-shingle sets are alike, as a metric-space join under Jaccard distance.

The distance of two sets is ``1 - |a and b| / |a or b|``, which obeys the triangle inequality. Equal sets are one
class. The join runs over *regions*, sets of classes that a linked pair must share:

1. With a fixed order of all shingles, two sets of similarity ``t`` share one of their first ``n - ceil(t n) + 1``, and
   what stands before the first one that they share bounds what they can share in all. A class enters a region per
   shingle of its prefix, with the largest partner that its place there allows. Regions drop classes that have no
   such partner in them. Rarest shingles come first, which puts a set's own before all that it shares. Only
   classes take part whose lowest hashes show that enough of their shingles occur elsewhere.
2. Regions of the same members are one, with the widest bounds of them.
3. In each region pivots are drawn, the classes with the smallest share of own shingles, which stand in the middle
   of their like. Distances to the region's pivots are exact. A class within the radius ``r`` of a pivot belongs to the
   Voronoi cell of its nearest one and is linked to it; a pivot and its cell leave the region.
4. By the triangle inequality a partner of a cell's class lies within ``2 r`` of the pivot. Classes between ``r`` and
   ``2 r`` are the cell's window and are kept with it; each meets only those of the cell's
   classes whose own distance from the pivot is less by ``r`` at most.
5. What lies beyond all cells is joined recursively with more pivots, until no region has two classes.
6. Cells are one component each. Only windows whose classes the links so far leave in another component are compared
   with the cell's classes, exactly.

Every pair at distance ``r`` or less is thus linked, or its ends are known to be connected. No region is
gathered in one task: pivots are minima, and distances are joins that adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlode.llm.common import components, discard, free, map_arrow, small
from reviewlode.llm.shingles import set_keys, shingle_sets
from reviewlode.session import fits_broadcast, land

# Share of a set, its lowest hashes, that is stored to tell which sets may have a partner: at least the share by which
# linked sets may differ.
LOW_PERCENT, LOW_LEAST = 30, 8
# Pivots of a region in the first round, how many times more in each next one, and at most.
FIRST_PIVOTS, MORE_PIVOTS, MOST_PIVOTS = 1, 8, 256


def _map(docs: DataFrame, schema: str, make: Callable, *columns: str) -> DataFrame:
    """Apply ``make(ids, texts)`` to Arrow batches of two columns; it gives arrays in schema order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = make(part.column(0), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in schema.split(", ")])

    return map_arrow(docs.select(*columns), run, schema)


def _low(n: int) -> int:
    return LOW_PERCENT * n // 100 + LOW_LEAST


def _sets(docs: DataFrame, key: str, text: str, k: int, whole: bool = False) -> DataFrame:
    """(id, n, a, b, grams): size, two hashes and the lowest hashes, or all, of every row's set."""

    def make(ids: pa.Array, texts: list) -> list:
        sets = list(shingle_sets(texts, k))
        keys = [set_keys(s) for s in sets]
        sizes = [len(s) for s in sets]
        return [
            ids,
            pa.array(sizes, pa.int64()),
            pa.array([x[0] for x in keys], pa.int64()),
            pa.array([x[1] for x in keys], pa.int64()),
            pa.array([(s if whole else s[: _low(n)]).view(np.int64) for s, n in zip(sets, sizes, strict=True)], pa.list_(pa.int64())),
        ]

    kind = docs.schema[key].dataType.simpleString()
    return _map(docs, f"id {kind}, n bigint, a bigint, b bigint, grams array<bigint>", make, key, text)


def _some(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if fits_broadcast(ids) else ids


def _largest(place: Column, percent: int) -> Column:
    """The largest partner of a set of ``n`` shingles whose first shared one stands at ``place``, counted from 0."""
    return F.floor((F.col("n") - place) * (100 + percent) / percent + 1e-9).cast("long") - F.col("n")


def _met(entries: DataFrame, percent: int) -> DataFrame:
    """``entries`` (g, c, n, most, ...) without those that have no partner within their bounds in their region."""
    for _ in range(2):
        span = entries.groupBy("g").agg(
            F.count(F.lit(1)).alias("members"), F.min("n").alias("least_n"), F.max("most").alias("most_most")
        )
        span = span.where("members > 1").select("g", "least_n", "most_most")
        entries = entries.join(span, "g").where("least_n <= most and n <= most_most").drop("least_n", "most_most")
    return entries


def _candidates(per_class: DataFrame, percent: int) -> DataFrame:
    """(c) of the classes (c, n, grams) that may have a partner.

    A linked set lacks ``n - ceil(t n)`` of another's ``n`` shingles at most, so all but as many of those that
    are stored must occur in some other class.
    """
    entries = per_class.select("c", F.explode("grams").alias("g"))
    shared = entries.groupBy("g").agg(F.count(F.lit(1)).alias("times"))
    shared = land(shared.where("times > 1").select("g"), "shared")
    common = entries.join(shared, "g").groupBy("c").agg(F.count(F.lit(1)).alias("common"))
    sizes = per_class.select("c", F.expr(f"size(grams) - n + ceil({percent} * n / 100)").alias("least"))
    found = land(common.join(sizes, "c").where("common >= least").select("c"), "candidates")
    discard(per_class.sparkSession, shared)
    return found


def _regions(whole: DataFrame, percent: int) -> DataFrame:
    """(g, c, n, most, own): the regions of classes (c, n, grams), rarest shingles first.

    ``most`` is the largest partner; ``own`` the share of shingles that no other class has.
    """
    spark = whole.sparkSession
    entries = whole.select("c", "n", F.explode("grams").alias("g"))
    shared = entries.groupBy("g").agg(F.count(F.lit(1)).alias("times"))
    shared = land(shared.where("times > 1"), "shared")
    rows = entries.join(shared, "g")
    ordered = Window.partitionBy("c").orderBy("times", "g")
    every = Window.partitionBy("c")
    rows = rows.withColumn("at", F.row_number().over(ordered) - 1).withColumn("common", F.count(F.lit(1)).over(every))
    place = F.col("n") - F.col("common") + F.col("at")
    rows = rows.where(place < F.expr(f"n + 1 - ceil({percent} * n / 100)"))
    own = ((F.col("n") - F.col("common")) / F.col("n")).alias("own")
    rows = land(rows.select("g", "c", "n", _largest(place, percent).alias("most"), own), "entries")
    regions = _distinct(_met(rows, percent))
    discard(spark, shared, rows)
    return regions


def _distinct(entries: DataFrame) -> DataFrame:
    """``entries`` with one region for all that have the same members, whose bounds are the widest."""
    entries = land(entries, "regions")
    print_of = [F.bit_xor(F.xxhash64("c", F.lit(i))).alias(f"print{i}") for i in (1, 2)]
    members = entries.groupBy("g").agg(F.count(F.lit(1)).alias("members"), *print_of).where("members > 1")
    names = ["members", "print1", "print2"]
    first = members.groupBy(*names).agg(F.min("g").alias("into"))
    into = members.join(first, names).select("g", "into")
    merged = entries.join(into, "g").groupBy(F.col("into").alias("g"), "c")
    out = land(merged.agg(F.first("n").alias("n"), F.max("most").alias("most"), F.first("own").alias("own")), "regions")
    discard(entries.sparkSession, entries)
    return out


def _near(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (x, p, ...) of classes that are alike by ``percent``, with ``both`` and ``any``."""
    sets = whole.select("c", "n", "grams")
    names = pairs.columns
    tried = pairs.join(sets.toDF("p", "n_p", "right"), "p").join(sets.toDF("x", "n_x", "left"), "x")
    both = F.size(F.array_intersect("left", "right")).cast("long")
    tried = tried.select(*names, both.alias("both"), (F.col("n_x") + F.col("n_p")).alias("sum"))
    tried = tried.select(*names, "both", (F.col("sum") - F.col("both")).alias("any"))
    return tried.where(F.expr(f"100 * both >= {percent} * any"))


def _join_regions(regions: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """(node, root) of every class with a link."""
    spark = regions.sparkSession
    twice = 2 * percent - 100  # similarity at distance 2 r
    linked = F.expr(f"100 * both >= {percent} * any")
    found, cells, windows = [], [], []
    n_pivots = FIRST_PIVOTS
    while not regions.isEmpty():
        slot = F.pmod(F.xxhash64("c", F.lit(n_pivots)), F.lit(n_pivots))
        best = F.min(F.struct("own", "c", "n")).alias("best")
        pivots = regions.groupBy("g", slot.alias("slot")).agg(best)
        pivots = land(pivots.select("g", F.col("best.c").alias("p"), F.col("best.n").alias("n_p")), "pivots")
        fits = F.expr(f"c <> p and 100 * least(n, n_p) >= {twice} * greatest(n, n_p)")
        pairs = regions.select("g", "c", "n").join(pivots, "g").where(fits)
        pairs = land(pairs.select("g", F.col("c").alias("x"), "p"), "region-pairs")
        met = pairs.select(F.least("x", "p").alias("x"), F.greatest("x", "p").alias("p")).distinct()
        near = land(_near(met, whole, twice), "distances")
        found.append(near.where(linked).select("x", "p"))
        like = (F.col("both") / F.col("any")).alias("like")
        near = near.select("x", "p", like, linked.alias("within"))
        both_ways = near.union(near.select("p", "x", "like", "within"))
        taken = pivots.select("g", F.col("p").alias("x"))
        rows = land(pairs.join(both_ways, ["x", "p"]).join(taken, ["g", "x"], "left_anti"), "region-distances")
        cell = rows.where("within").groupBy("g", "x").agg(F.max(F.struct("like", "p")).alias("best"))
        cell = land(cell.select("g", "x", "best.p", "best.like"), "cells")
        cells.append(cell.select("p", "x", "like").distinct())
        windows.append(land(rows.where("not within").select("p", F.col("x").alias("y"), F.col("like").alias("y_like")).distinct(), "windows"))
        gone = taken.union(cell.select("g", "x")).withColumnRenamed("x", "c")
        left = _distinct(_met(regions.join(gone, ["g", "c"], "left_anti"), percent))
        discard(spark, pairs, rows, pivots, regions)
        regions = left
        n_pivots = min(MORE_PIVOTS * n_pivots, MOST_PIVOTS)
    if not found:
        return spark.createDataFrame([], "node bigint, root bigint")
    links = land(reduce(DataFrame.union, found).toDF("u", "v"), "links")
    roots = components(links)
    # Windows count only where the links so far leave their class apart from the cell.
    cell = land(reduce(DataFrame.union, cells).distinct(), "all-cells")
    window = land(reduce(DataFrame.union, windows).distinct(), "all-windows")
    of = small(roots.withColumnRenamed("node", "y"))
    side = small(roots.toDF("p", "p_root"))
    window = window.join(of, "y", "left").join(side, "p", "left").where("coalesce(root, y) <> coalesce(p_root, p)")
    # A cell's classes are taken over all regions at once, so a pair is made once and not once per region.
    sizes = whole.select("c", "n", "most")
    sizes_y, sizes_x = sizes.toDF("y", "n_y", "most_y"), sizes.toDF("x", "n_x", "most_x")
    window = window.join(sizes_y, "y").select("p", "y", "y_like", "n_y", "most_y")
    rest = cell.join(sizes_x, "x").join(window, "p")
    fits = f"x <> y and n_y <= most_x and n_x <= most_y and like - y_like <= {(100 - percent) / 100} + 1e-9"
    rest = rest.where(fits).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("p")).distinct()
    more = land(_near(land(rest, "window-pairs"), whole, percent).select("x", "p"), "window-links")
    return roots if more.isEmpty() else components(links.union(more))


def _classes(docs: DataFrame, key: str, text: str, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per row (id, n, a, b); per class (c, a, b, n, id); (node, root) of the classes with a link.

    A class is a set with at least one shingle, known by both of its hashes; ``c`` is a number.
    """
    spark = docs.sparkSession
    per_row = land(_sets(docs, key, text, k), "sets")
    classes = per_row.where("n > 0").groupBy("a", "b", "n").agg(F.min("id").alias("id"))
    classes = land(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    # The rows of a class hold the same set; that of the smallest id stands for it, or any where none has an id.
    named = _some(classes.select("id", "a", "b", "c").where("id is not null"))
    first = per_row.join(named, ["id", "a", "b"]).select("c", "n", "grams")
    nameless = classes.where("id is null").select("a", "b", "c")
    some_nameless = not nameless.isEmpty()
    if some_nameless:
        first = first.union(per_row.where("id is null").join(nameless, ["a", "b"]).select("c", "n", "grams"))
    repeated = not per_row.groupBy("id", "a", "b").count().where("count > 1").isEmpty()
    per_class = first.dropDuplicates(["c"]) if repeated else first
    candidates = _candidates(per_class, percent)
    wanted = land(classes.join(candidates, "c"), "wanted")
    texts = docs.join(_some(wanted.select(F.col("id").alias(key)).where(F.col(key).isNotNull()).distinct()), key, "left_semi")
    texts = texts.select(key, text)
    if some_nameless:
        texts = texts.union(docs.where(F.col(key).isNull()).select(key, text))
    whole = _sets(texts, key, text, k, whole=True).select("a", "b", "n", "grams")
    whole = whole.join(_some(wanted.select("a", "b", "c")), ["a", "b"]).select("c", "n", "grams")
    whole = land(whole.dropDuplicates(["c"]) if repeated else whole, "whole")
    regions = _regions(whole, percent)
    # The largest partner at the first place that a region has.
    bounds = regions.groupBy("c").agg(F.max("most").alias("most"))
    kept = land(whole.join(_some(land(bounds, "bounds")), "c"), "whole")
    discard(spark, whole, candidates, wanted)
    return per_row.drop("grams"), classes, _join_regions(regions, kept, percent)


def _components(docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """(id, n, a, b, group, low): per row its component's class and smallest id; null without a shingle."""
    per_row, classes, roots = _classes(docs, key, text, k, percent)
    named = classes.join(small(roots.withColumnRenamed("node", "c")), "c", "left")
    named = land(named.select("a", "b", "n", "id", F.coalesce("root", "c").alias("group")), "named")
    low = land(named.groupBy("group").agg(F.min("id").alias("low")), "lows")
    named = land(named.drop("id").join(small(low), "group"), "groups")
    return per_row.join(small(named), ["a", "b", "n"], "left")


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """(id, n_shingles, component_id) per row of ``docs``.

    A row's component is the smallest id reachable over links, pairs of sets with ``100 * |a and b| >=
    percent * |a or b|`` (``percent`` above 50). Equal sets, and so equal texts and repeated rows, are
    one class. Null, empty and blank texts have no shingle and link with nothing. Rows with a null id link
    like all others; where a component has no other rows, its id is null. Rows that share an id may
    hold different texts and then have components of their own. Other columns of ``docs`` are not read.
    """
    rows = _components(docs, key, text, k, percent)
    return rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("low", "id").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` of each component, that of the smallest id; columns and their order are kept.

    Where ids are null or repeat, rows are numbered first, and of rows with the smallest id, or with
    none at all, one stays. Rows without a shingle all stay, but of those that also repeat the id one does.
    """
    mark, number = free(docs.columns, "kept_id"), free(docs.columns, "kept_row")
    ids = docs.select(F.col(key).alias("id"))
    unique = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").isEmpty()
    if unique:
        rows = _components(docs, key, text, k, percent)
        best = land(rows.where("low is null or low = id").select(F.col("id").alias(mark)), "kept-ids")
        return docs.join(_some(best), F.col(key) == F.col(mark), "left_semi")
    numbered = land(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    rows = land(_components(numbered.select(number, text), number, text, k, percent).select("id", "low"), "rows")
    given = numbered.select(F.col(number).alias("id"), F.col(key).alias("given"))
    rows = rows.join(given, "id")
    order = F.struct(F.col("given").isNull().alias("none"), "given", "id")
    alike = rows.where("low is not null").groupBy("low").agg(F.min(order).alias("best")).select("best.id")
    empty = rows.where("low is null and given is not null").groupBy("given").agg(F.min("id").alias("id")).select("id")
    empty = empty.union(rows.where("low is null and given is null").select("id"))
    best = land(alike.union(empty).select(F.col("id").alias(mark)), "kept-rows")
    return numbered.join(_some(best), F.col(number) == F.col(mark), "left_semi").select(*[f"`{c}`" for c in docs.columns])
