"""Word vectors whose weights are a table: skip-grams with negative samples, learned block by block.

Texts are dealt to blocks. A block has the weights of its own words only; it learns from its texts, and a word's new
weights are the mean over the blocks that hold it, as in Spark's ``Word2Vec``. Weights go from blocks to words and back
in shuffles, so neither the driver nor any task ever holds those of all words.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from reviewlode.operators.blocks import in_blocks, lookup_words, words_of_blocks
from reviewlode.operators.tokens import BLOCK_WORDS
from reviewlode.session import workers_find_package

# Words on either side, noise words for each pair (drawn for a stretch of words together), and the first step's length.
WINDOW, NOISE, DRAWN, RATE = 5, 5, 64, 0.025
# Words whose steps are added up before the weights move, and the steps of one word that count in full among them.
STRETCH, FULL_STEPS = 512, 32
# Passes that a block makes before the weights are merged.
PASSES_ALONE = 2
# Bytes of weights that one task merges.
MERGED_BYTES = 64 << 20

_STATE = "_block long, id int, n long, weights array<float>"


class WordVectors(Transformer):
    """Vectors of words as a stored table ``token, vector``; a text's vector is their mean over all its words."""

    def __init__(self, table: DataFrame, column: str, output: str, size: int):
        super().__init__()
        self.table, self.column, self.output, self.size = table, column, output, size

    def getVectors(self) -> DataFrame:
        return self.table.select(F.col("token").alias("word"), array_to_vector("vector").alias("vector"))

    def _transform(self, df: DataFrame) -> DataFrame:
        column, size = self.column, self.size
        schema = StructType([*df.schema.fields, StructField("_mean", ArrayType(DoubleType()))])

        def find(texts: pa.Table, known: pa.Table) -> pa.Table:
            lists = texts[column].combine_chunks()
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            text = np.repeat(np.arange(len(lengths)), lengths)
            at = pc.index_in(lists.flatten(), value_set=known["token"].combine_chunks())
            there = at.is_valid().to_numpy(zero_copy_only=False)
            place, text = at.drop_null().to_numpy(), text[there]
            vectors = known["vector"].combine_chunks().flatten().to_numpy().reshape(-1, size)
            sums = [np.bincount(text, weights=vectors[place, i], minlength=len(lengths)) for i in range(size)]
            means = (np.stack(sums, axis=1) / np.maximum(lengths, 1)[:, None]).ravel()
            ends = pa.array(np.arange(len(lengths) + 1, dtype=np.int32) * size)
            return texts.drop_columns(["_block"]).append_column("_mean", pa.ListArray.from_arrays(ends, pa.array(means)))

        numbered = df.withColumn("_row", F.monotonically_increasing_id())
        blocks = in_blocks(numbered, F.greatest(F.size(column), F.lit(0)), BLOCK_WORDS).drop("_row")
        held = words_of_blocks(blocks, column)
        found = lookup_words(blocks, held, self.table, [F.col(c) for c in df.columns], find, schema)
        return found.select(*df.columns, array_to_vector("_mean").alias(self.output))


# --- learning within a block -------------------------------------------------------------------


def _spread_out(weights: np.ndarray, order: np.ndarray, steps: np.ndarray, counts: np.ndarray, rate: float) -> None:
    """Move the rows ``order`` names by their steps; a row named too often moves by the mean of them, times ``FULL_STEPS``."""
    by = np.argsort(order, kind="stable")
    named, starts = np.unique(order[by], return_index=True)
    total, n = np.add.reduceat(steps[by], starts), np.add.reduceat(counts[by], starts)
    weights[named] += rate * total / np.maximum(1.0, n / FULL_STEPS)[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def learn(words: np.ndarray, text: np.ndarray, n: np.ndarray, weights: np.ndarray, rate: float, draw: np.random.Generator) -> None:
    """One pass over a block: ``words`` are places in ``weights`` (vector, then context), ``text`` the text of each.

    Pairs are words of one text at most ``WINDOW`` apart, near ones more often. Noise follows ``n`` to the 3/4.
    """
    size = weights.shape[1] // 2
    vectors, contexts = weights[:, :size], weights[:, size:]
    often = np.cumsum(n.astype(float) ** 0.75)
    for first in range(0, len(words), STRETCH):
        here = words[first : first + STRETCH + WINDOW]
        own, v, c = min(STRETCH, len(words) - first), vectors[here], contexts[here]
        to_v, to_c, pairs = np.zeros_like(v), np.zeros_like(c), np.zeros(len(here), dtype=np.float32)
        for d in range(1, min(WINDOW, len(here) - 1) + 1):
            a, b = slice(0, min(own, len(here) - d)), slice(d, d + min(own, len(here) - d))
            near = text[first : first + STRETCH + WINDOW]
            paired = (near[a] == near[b]) & (draw.random(a.stop) * WINDOW < WINDOW + 1 - d)
            for x, y in ((a, b), (b, a)):
                missing = (paired * (1.0 - _sigmoid(np.einsum("ij,ij->i", v[x], c[y]))))[:, None].astype(np.float32)
                to_v[x] += missing * c[y]
                to_c[y] += missing * v[x]
                pairs[x] += paired
        noise = np.searchsorted(often, draw.random(DRAWN) * often[-1], side="right").astype(np.int64)
        u = contexts[noise]
        false = (_sigmoid(v @ u.T) * (pairs * NOISE / DRAWN)[:, None]).astype(np.float32)
        to_v -= false @ u
        _spread_out(vectors, here, to_v, pairs * (1 + NOISE), rate)
        _spread_out(
            contexts, np.concatenate([here, noise]), np.concatenate([to_c, -(false.T @ v)]),
            np.concatenate([pairs, np.full(DRAWN, pairs.sum() * NOISE / DRAWN, np.float32)]), rate,
        )


def learn_block(width: int, rates: list[float], seed: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The weights of a block's words after a pass at each of ``rates``; texts go by their number."""

    def learned(texts: pa.Table, state: pa.Table) -> pa.Table:
        if not state.num_rows:
            return state
        state, texts = state.sort_by("id"), texts.sort_by("_row")
        weights = state["weights"].combine_chunks().flatten().to_numpy().reshape(-1, width).copy()
        lists = texts["ids"].combine_chunks()
        text = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        words = np.searchsorted(state["id"].to_numpy(), lists.flatten().to_numpy())
        for turn, rate in enumerate(rates):
            draw = np.random.default_rng([seed, state["_block"][0].as_py(), turn])
            learn(words, text, state["n"].to_numpy(), weights, rate, draw)
        return state.set_column(3, "weights", _lists(weights))

    return learned


def _lists(weights: np.ndarray) -> pa.ListArray:
    ends = pa.array(np.arange(len(weights) + 1, dtype=np.int32) * weights.shape[1])
    return pa.ListArray.from_arrays(ends, pa.array(weights.ravel()))


def merge(state: pa.Table, width: int) -> pa.Table:
    """Every block's row of a word gets the mean over its blocks."""
    state = state.sort_by([("id", "ascending"), ("_block", "ascending")])
    _, starts, sizes = np.unique(state["id"].to_numpy(), return_index=True, return_counts=True)
    weights = state["weights"].combine_chunks().flatten().to_numpy().reshape(-1, width)
    means = (np.add.reduceat(weights, starts) / sizes[:, None]).astype(np.float32)
    return state.set_column(3, "weights", _lists(np.repeat(means, sizes, axis=0)))


# --- learning ----------------------------------------------------------------------------------


def train(texts: DataFrame, held: DataFrame, rows: int, size: int, passes: int, seed: int) -> DataFrame:
    """``id, vector`` after ``passes`` over ``texts`` (_row, _block, ids); ``held`` (_block, id, n) are a block's words, ``rows`` in all."""
    spark, width = texts.sparkSession, 2 * size
    workers_find_package(spark)
    buckets = max(spark.sparkContext.defaultParallelism, -(-rows * width * 4 // MERGED_BYTES))
    start = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: ((F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(1 << 24)) / (1 << 24) - 0.5) / size).cast("float"),
    )
    zeros = F.array_repeat(F.lit(0.0).cast("float"), size)
    state = held.select("_block", "id", "n", F.concat(start, zeros).alias("weights"))
    for done in range(0, passes, PASSES_ALONE):
        rates = [RATE * (1 - turn / passes) for turn in range(done, min(done + PASSES_ALONE, passes))]
        step = learn_block(width, rates, seed + done)
        learned = texts.groupBy("_block").cogroup(state.groupBy("_block")).applyInArrow(step, _STATE)
        bucket = F.pmod(F.xxhash64("id"), F.lit(buckets))
        state = learned.groupBy(bucket).applyInArrow(lambda t: merge(t, width), _STATE)
    first = state.groupBy("id").agg(F.min_by("weights", "_block").alias("weights"))
    return first.select("id", F.slice("weights", 1, size).alias("vector"))
