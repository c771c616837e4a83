"""Near duplicates of vectors: random-hyperplane signs in several tables, exact cosines, components.

A table's key is the sign of a vector against random hyperplanes, ``EXTRA_BITS`` more than the bits of the
largest label's count, so unlike vectors rarely meet at any size. Two vectors at the threshold agree on a plane
with probability ``1 - acos(t) / pi``; there are as many tables as make a miss in all of them rarer than
``MISS``. Equal vectors are one class with a weight, so copies meet only once. Vectors meet in
buckets; a large bucket is a triangle of blocks, each worked on as one matrix product, and what leaves a
task is one row per vector of the block, never a row per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlode.llm.common import components, free, map_arrow, small, workers_find_package
from reviewlode.session import land

EXTRA_BITS = 4
MISS = 1e-5
SEED = 8
# Vectors of a bucket that one block holds; smaller buckets share a task's group up to about PACK vectors.
BLOCK = 512
PACK = 256


def shape(n: int, threshold: float) -> tuple[int, int]:
    """(bits, tables) for labels of at most ``n`` different vectors."""
    bits = min(60, max(1, n).bit_length() + EXTRA_BITS)
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-meet)) if meet < 1 else 1


def planes(dimension: int, bits: int, tables: int, seed: int) -> np.ndarray:
    """Normals of all hyperplanes, (dimension, tables * bits)."""
    return np.random.default_rng([seed, dimension]).standard_normal((dimension, tables * bits))


def _usable(vector: str) -> Column:
    return F.expr(
        f"`{vector}` is not null and not exists(`{vector}`, x -> x is null or isnan(x) or abs(x) = double('inf'))"
        f" and exists(`{vector}`, x -> x <> 0)"
    )


def _signed(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """``classes`` (c, label, v) with ``keys``: a bucket key per table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            widths = vectors.value_lengths().to_numpy()
            for width in np.unique(widths).tolist():
                rows = np.flatnonzero(widths == width)
                values = vectors.take(pa.array(rows)).flatten().to_numpy().reshape(-1, width)
                normals = known.setdefault(width, planes(width, bits, tables, seed))
                signs = (values / np.abs(values).max(axis=1, keepdims=True)) @ normals > 0
                keys = signs.reshape(len(rows), tables, bits) @ powers
                out = [ids.take(pa.array(rows)), pa.array(list(keys), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(out, names=["c", "keys"])

    return map_arrow(classes.select("c", "v"), run, "c bigint, keys array<bigint>")


def _block(left: pa.Table, right: pa.Table | None, table: int, threshold: float) -> pa.Table:
    """(c, links, root) for the vectors of one or two blocks: weights linked here, and a component id.

    A pair counts in the first table in which it meets, so no link is counted twice.
    """
    both = left if right is None else pa.concat_tables([left, right])
    ids = both.column("c").to_numpy()
    keys = np.array(both.column("keys").to_pylist(), np.int64)
    weights = both.column("weight").to_numpy()
    widths = both.column("v").combine_chunks().value_lengths().to_numpy()
    n, m = both.num_rows, left.num_rows
    links, root = np.zeros(n, np.int64), np.arange(n)
    linked = np.zeros((n, n), bool)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        values = np.array(both.column("v").take(pa.array(rows)).to_pylist(), np.float64)
        values /= np.abs(values).max(axis=1, keepdims=True)
        values /= np.sqrt((values * values).sum(axis=1, keepdims=True))
        linked[np.ix_(rows, rows)] = values @ values.T >= threshold
    np.fill_diagonal(linked, False)
    buckets = both.column("bucket").to_numpy()
    linked &= buckets[:, None] == buckets[None, :]
    if right is not None:  # within a block its own task counts
        linked[:m, :m] = linked[m:, m:] = False
    for earlier in range(table):
        linked &= keys[:, earlier][:, None] != keys[:, earlier][None, :]
    links = linked @ weights
    while True:
        low = np.where(linked, root[None, :], n).min(axis=1)
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    hit = links > 0
    return pa.table({"c": ids[hit], "links": links[hit], "root": ids[root[hit]]})


def near_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = 0.98,
    seed: int = SEED,
) -> DataFrame:
    """(key, n_links, component_id, kept) per row of ``vectors``.

    Two vectors link when their labels are equal and not null and their cosine in double precision is at
    least ``threshold``; every link is checked, so none lies below it. Vectors of different lengths do not
    link, nor do null or zero vectors or such that hold null or non-finite values. Repeated rows are
    vectors of their own. Other columns are not read.
    """
    workers_find_package(vectors.sparkSession)
    rows = vectors.select(
        F.col(key).cast("long").alias("id"),
        F.col(label).alias("label"),
        F.expr(f"transform(`{vector}`, x -> cast(x as double) + double(0))").alias("v"),
    )
    usable = _usable("v") & F.col("label").isNotNull()
    # Equal vectors of a label are one class, named by its smallest id.
    rows = rows.withColumn("print", F.when(usable, F.sha2(F.to_json(F.struct("label", "v")), 256)))
    rows = land(rows, "vectors")
    classes = rows.where("print is not null").groupBy("print").agg(
        F.min("id").alias("c"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("v").alias("v")
    )
    classes = land(classes, "classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = shape(largest, threshold)
    signed = land(_signed(classes, bits, tables, seed), "signs")
    spread = signed.join(classes.select("c", "label"), "c").select("c", "label", F.posexplode("keys").alias("t", "sign"))
    buckets = spread.groupBy("label", "t", "sign").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = land(buckets.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "buckets")
    few = buckets.where("blocks = 1").agg(F.sum("n")).first()[0] or 0
    packs = -(-few // (PACK * tables)) or 1
    member = spread.join(buckets.drop("n"), ["label", "t", "sign"])
    member = member.withColumn("mine", F.pmod(F.xxhash64("c", "t"), F.col("blocks")).cast("int"))
    # Block i of a bucket meets itself and every other block once.
    member = member.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    member = member.select(
        F.xxhash64("label", "t", "sign").alias("bucket"), "t", "c", "mine", (F.col("blocks") > 1).alias("large"),
        F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
    )
    pack = F.when(F.col("large"), F.col("bucket")).otherwise(F.pmod(F.col("bucket"), F.lit(packs)))
    member = land(member.withColumn("pack", pack), "members")
    body = signed.join(classes.select("c", "v", "weight"), "c")
    member = member.join(body, "c")

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        t, i, j = (rows.column(x)[0].as_py() for x in ("t", "i", "j"))
        mine = rows.column("mine").to_numpy()
        left = rows.filter(pa.array(mine == i))
        return _block(left, None if i == j else rows.filter(pa.array(mine == j)), t, threshold)

    found = member.groupBy("t", "large", "pack", "i", "j").applyInArrow(work, "c bigint, links bigint, root bigint")
    found = land(found, "links")
    counts = found.groupBy("c").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("c").alias("u"), F.col("root").alias("v")))
    facts = classes.select("print", "c", "weight").join(counts, "c", "left")
    facts = facts.join(roots.withColumnRenamed("node", "c"), "c", "left")
    facts = facts.select(
        "print",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("root", "c").alias("component_id"),
    )
    out = rows.select("id", "print").join(small(facts), "print", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def keep_one(vectors: DataFrame, key: str = "vec_id", **options: str) -> DataFrame:
    """The rows of ``vectors`` that name their component."""
    mark = free(vectors.columns, "kept_vector")
    kept = near_vectors(vectors, key, **options).where("kept").select(F.col(key).alias(mark)).distinct()
    return vectors.join(small(kept), F.col(key).eqNullSafe(F.col(mark)), "left_semi")
