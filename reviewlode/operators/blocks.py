"""Words of whole texts looked up in a table, block by block.

Texts are dealt to blocks of even size. A block asks for each of its distinct words once, however often
it holds them, and the task that has a block's texts gets what was found. So texts move once, as texts, and
neither their running words nor the table go through a shuffle or a broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reviewlode.operators.surface import kinds, surface_tokens
from reviewlode.session import landed, workers_find_package


def in_blocks(df: DataFrame, weight: Column, most: int) -> DataFrame:
    """``df``, stored, with its ``_block``: blocks hold about ``most`` of ``weight`` and lie in one task each."""
    return dealt(landed(df, "texts"), weight, most)


def dealt(stored: DataFrame, weight: Column, most: int) -> DataFrame:
    """:func:`in_blocks` of a table that is stored already."""
    total = stored.agg(F.sum(weight)).first()[0] or 0
    blocks = max(stored.sparkSession.sparkContext.defaultParallelism, -(-total // most))
    return stored.withColumn("_block", F.pmod(F.xxhash64(*stored.columns), F.lit(blocks))).repartition("_block")


def words_of_blocks(blocks: DataFrame, column: str) -> DataFrame:
    """``_block, token``: the distinct entries of an array column in each block."""
    return _distinct(blocks, lambda texts: texts[column].combine_chunks().flatten().drop_null())


def surface_of_blocks(blocks: DataFrame, column: str) -> DataFrame:
    """``_block, token``: the distinct surface tokens of each block's texts."""
    table_of = kinds(blocks.sparkSession)
    return _distinct(blocks, lambda texts: surface_tokens(texts[column].combine_chunks(), table_of).words)


def _distinct(blocks: DataFrame, words_of: Callable[[pa.Table], pa.Array]) -> DataFrame:
    """The distinct words of each block. All columns are asked for, so that texts are dealt once, here and in the lookup."""
    workers_find_package(blocks.sparkSession)

    def distinct(texts: pa.Table) -> pa.Table:
        found = pc.unique(words_of(texts))
        words = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found)
        return pa.table([texts["_block"][:1], words], names=["_block", "words"])

    held = blocks.groupBy("_block").applyInArrow(distinct, "_block long, words array<string>")
    return held.select("_block", F.explode("words").alias("token"))


def lookup_words(
    blocks: DataFrame,
    held: DataFrame,
    entries: DataFrame,
    columns: list[Column],
    find: Callable[[pa.Table, pa.Table], pa.Table],
    schema: StructType | str,
) -> DataFrame:
    """``find`` of each block's ``columns`` and of the ``entries`` (token, ...), one per token, for what it ``held``."""
    workers_find_package(blocks.sparkSession)
    known = held.join(entries, "token").withColumnRenamed("_block", "_of")
    texts = blocks.select("_block", *columns)
    return texts.groupBy("_block").cogroup(known.groupBy("_of")).applyInArrow(find, schema)
