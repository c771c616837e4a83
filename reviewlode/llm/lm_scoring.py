"""Language-model scores of whole texts by context-tree weighting, trained and applied on Spark.

1. Every task counts grams and words of its texts; counts meet by key. All texts give keys, so the tree is
   evaluated for every gram that scoring will meet; only training texts give counts.
2. Grams are grouped by their two nearest context bytes. Each group is a whole subtree and is weighed alone; the
   groups' roots, at most 256 x 256 contexts, give the two top levels.
3. Each group then evaluates its grams, which makes scoring a sum of table values over a text's bytes.
4. The most frequent keys, at most ``HEAD``, are broadcast. Occurrences of all others are joined by key.

The word table for the unigram base is used in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlode.llm.common import doc_hash, map_arrow, workers_find_package
from reviewlode.llm.context_tree import (
    Lookup,
    Nodes,
    code,
    grams_of,
    lift,
    log_probability,
    subtree,
)
from reviewlode.llm.shingles import word_hashes
from reviewlode.session import land

DEPTH = 5
HEAD = 600_000
# Texts worked on at once, and their bytes; a longer text is worked on alone.
STEP, STEP_BYTES = 300, 400_000
# Keys a task gathers before it adds them up, and sums it holds before it passes them on.
GATHER, HOLD = 1_000_000, 500_000
GRAM, WORD = 0, 1


def held_out(key: str, folds: int = 10) -> Column:
    """Rows that the model does not learn from."""
    return F.pmod(doc_hash(F.col(key)), F.lit(folds)) == 0


def _words(coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of coded texts, and where each text's begin; the end token is the hash -1."""
    hashes, starts = word_hashes(b"".join(coded))
    bounds = np.concatenate(([0], np.cumsum([len(c) for c in coded])))
    cuts = np.searchsorted(starts, bounds)
    out = np.insert((hashes >> np.uint64(1)).view(np.int64), cuts[1:], -1)
    return out, cuts[:-1] + np.arange(len(coded))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[int]]]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
        at = 0
        while at < batch.num_rows:
            fits = int(np.searchsorted(np.cumsum(sizes[at : at + STEP]), STEP_BYTES, side="right"))
            part = batch.slice(at, max(1, fits))
            at += part.num_rows
            made = [code(t) for t in part.column("text").to_pylist()]
            yield part, [c for c, _ in made], [n for _, n in made]


def _counts(rows: DataFrame, depth: int) -> DataFrame:
    """(kind, key, n, total): occurrences in training texts and in all; ``rows``: text, learn."""

    def total(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
        keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        sums = [np.bincount(at, weights=np.concatenate([p[i] for p in parts]), minlength=len(keys)) for i in (1, 2)]
        return keys, *sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {GRAM: [], WORD: []}

        def flush(kind: int) -> pa.RecordBatch:
            keys, n, everything = total(kept[kind])
            kept[kind] = []
            columns = [np.full(len(keys), kind, np.int32), keys, n.astype(np.int64), everything.astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "key", "n", "total"])

        for part, coded, _ in _steps(batches):
            learn = np.array(part.column("learn").to_pylist(), bool)
            for kind, (keys, starts) in ((GRAM, grams_of(coded, depth)), (WORD, _words(coded))):
                mine = np.repeat(learn, np.diff(np.append(starts, len(keys))))
                once, at = np.unique(keys, return_inverse=True)
                n, everything = (np.bincount(at, weights=w, minlength=len(once)) for w in (mine, None))
                kept[kind].append((once, n, everything))
                if sum(len(k) for k, _, _ in kept[kind]) > GATHER:
                    kept[kind] = [total(kept[kind])]
                    if len(kept[kind][0][0]) > HOLD:
                        yield flush(kind)
        for kind in (GRAM, WORD):
            if kept[kind]:
                yield flush(kind)

    counted = map_arrow(rows, run, "kind int, key bigint, n bigint, total bigint")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _top(context: str, depth: int) -> Column:
    return F.shiftright(context, 8 * (depth - 1))


def _tree(grams: DataFrame, depth: int) -> DataFrame:
    """(key, total, value): log10 probability of the last byte of every gram (key, n, total)."""
    spark = grams.sparkSession
    workers_find_package(spark)
    grouped = grams.withColumn("top", _top("key", depth))

    def own(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, dict[int, Nodes]]:
        keys, n = rows.column("key").to_numpy(), rows.column("n").to_numpy()
        return keys, n, subtree(keys, n, depth, 2) if (n > 0).any() else {}

    def roots(rows: pa.Table) -> pa.Table:
        nodes = own(rows)[2].get(2)
        if nodes is None:
            nodes = Nodes(*[np.empty(0, t) for t in (np.int64, float, float, float, float)])
        return pa.table({"node": nodes.ids, "zeros": nodes.zeros, "ones": nodes.ones, "worth": nodes.worth})

    # At most 256 x 256 contexts with 255 decisions each; one decision's are worked on together.
    second = grouped.groupBy("top").applyInArrow(roots, "node bigint, zeros double, ones double, worth double")

    def tops(rows: pa.Table) -> pa.Table:
        ids, zeros, ones, worth = (rows.column(c).to_numpy() for c in ("node", "zeros", "ones", "worth"))
        first = lift(Nodes(ids, zeros, ones, worth, np.ones(len(ids))))
        root = lift(first)
        parts = [(1, first), (0, root)]
        columns = {
            "depth": np.concatenate([np.full(len(x.ids), d, np.int32) for d, x in parts]),
            "node": np.concatenate([x.ids for _, x in parts]),
            "zeros": np.concatenate([x.zeros for _, x in parts]),
            "ones": np.concatenate([x.ones for _, x in parts]),
            "own": np.concatenate([x.own for _, x in parts]),
        }
        return pa.table(columns)

    decision = F.col("node").bitwiseAND(F.lit(255)).alias("decision")
    tops_at = second.select("*", decision).groupBy("decision")
    found = tops_at.applyInArrow(tops, "depth int, node bigint, zeros double, ones double, own double").toArrow()
    shared = {}
    for d in (0, 1):  # 256 contexts x 255 decisions at most
        rows = found.filter(pa.array(found.column("depth").to_numpy() == d)).sort_by("node")
        ids, zeros, ones, weight = (rows.column(c).to_numpy() for c in ("node", "zeros", "ones", "own"))
        shared[d] = Nodes(ids, zeros, ones, np.zeros(len(ids)), weight)
    shared = spark.sparkContext.broadcast(shared)

    def values(rows: pa.Table) -> pa.Table:
        keys, _, nodes = own(rows)
        value = log_probability(keys, depth, {**shared.value, **nodes})
        return pa.table({"key": keys, "total": rows.column("total"), "value": value})

    return grouped.groupBy("top").applyInArrow(values, "key bigint, total bigint, value double")


def _head(values: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent keys of (key, total, value), at most ``limit``."""
    steps = values.groupBy(F.floor(4 * F.log2("total")).alias("step")).agg(F.count(F.lit(1)).alias("k")).collect()
    least, size = None, 0
    for row in sorted(steps, key=lambda r: -r["step"]):
        size += row["k"]
        if size > limit:
            break
        least = row["step"]
    if least is None:
        return np.empty(0, np.int64), np.empty(0)
    rows = values.where(F.floor(4 * F.log2("total")) >= least).select("key", "value").toArrow()
    return rows.column("key").to_numpy(), rows.column("value").to_numpy()


def _rest(keys: np.ndarray, hit: np.ndarray, starts: np.ndarray) -> list[pa.Array]:
    """Keys that a table does not hold, with their counts, as two lists per text."""
    missing = np.flatnonzero(~hit)
    owner, keys = np.searchsorted(starts, missing, side="right") - 1, keys[missing]
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(keys)))
    offsets = pa.array(np.searchsorted(owner[first], np.arange(len(starts) + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64))) for x in (keys[first], n)]


def _sums(rows: DataFrame, depth: int, grams: Broadcast, words: Broadcast) -> DataFrame:
    """Per row (id, text): sums over keys in the broadcast tables, and the other keys with their counts."""
    kind = rows.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, n_tokens bigint, score double, grams array<bigint>, gram_n array<bigint>, "
        "base double, words array<bigint>, word_n array<bigint>, n_known bigint"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_table, word_table = Lookup(*grams.value), Lookup(*words.value)
        for part, coded, n_tokens in _steps(batches):
            keys, starts = grams_of(coded, depth)
            value, hit = gram_table.get(keys)
            columns = [part.column("id"), pa.array(n_tokens, pa.int64()), pa.array(np.add.reduceat(value, starts))]
            columns += _rest(keys, hit, starts)
            keys, starts = _words(coded)
            value, hit = word_table.get(keys)
            columns += [pa.array(np.add.reduceat(value, starts)), *_rest(keys, hit, starts)]
            columns.append(pa.array(np.add.reduceat(hit.astype(np.int64), starts)))
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return map_arrow(rows.select("id", "text"), run, schema)


def _tail(scored: DataFrame, keys: str, counts: str) -> DataFrame:
    pair = F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(counts).alias("times"))).alias("pair")
    return scored.where(F.size(keys) > 0).select("row", pair).select("row", "pair.key", "pair.times")


def score(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    learn: Column | None = None,
    depth: int = DEPTH,
    head: int = HEAD,
) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row's whole text.

    A text stands for its lower-case words with one blank between and an end token; a null or empty text is the
    end alone. ``learn`` marks the rows to learn from (by default those not ``held_out``). ``score`` is the
    model's log10 probability of these bytes, ``base_score`` that of the tokens under smoothed word counts.
    Without rows to learn from every bit has probability one half. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    learn = ~held_out(key) if learn is None else learn
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    counts = land(_counts(rows.select("text", "learn"), depth), "counts")
    grams = land(_tree(counts.where(F.col("kind") == GRAM).select("key", "n", "total"), depth), "values")
    known = counts.where((F.col("kind") == WORD) & (F.col("n") > 0))
    n_train, kinds = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    below = n_train + 0.1 * (kinds + 1)
    known = known.select("key", F.col("n").alias("total"), F.log10((F.col("n") + 0.1) / below).alias("value"))
    context = spark.sparkContext
    scored = _sums(rows, depth, context.broadcast(_head(grams, head)), context.broadcast(_head(known, head)))
    scored = land(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    more = _tail(scored, "grams", "gram_n").join(grams.select("key", "value"), "key")
    more = more.groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("more"))
    rest = _tail(scored, "words", "word_n").join(known.select("key", "value"), "key", "left")
    rest = rest.groupBy("row").agg(
        F.sum(F.col("times") * F.coalesce("value", F.log10(F.lit(0.1) / below))).alias("rest"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("times")).otherwise(0)).alias("rest_known"),
    )
    out = scored.select("row", "id", "n_tokens", "n_known", "base", "score")
    out = out.join(more, "row", "left").join(rest, "row", "left")
    total = F.col("score") + F.coalesce("more", F.lit(0.0))
    return out.select(
        F.col("id").alias(key),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        total.alias("score"),
    )
