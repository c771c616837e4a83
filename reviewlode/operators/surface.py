"""Surface tokens of many texts at once, by the rules of :func:`text.tokenise`.

A task looks up the kind of every code point in a table and cuts texts where the kind changes, for about
``PIECE`` bytes of text at a time. One regular expression per text costs several times as much.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlode.functions import text as X
from reviewlode.session import workers_find_package

# Kinds of code points: between tokens, in words, in runs of signs, and between sentences.
BLANK, WORD, SIGN, END = range(4)

# Bytes of text cut at a time, and bytes whose words are counted together.
PIECE, COUNTED = 1 << 20, 8 << 20


@dataclass(frozen=True)
class Kinds:
    """The kind of every code point, as runs of equal ones: their lengths and their kinds."""

    lengths: bytes
    values: bytes

    @lru_cache(maxsize=1)
    def table(self) -> np.ndarray:
        return np.repeat(np.frombuffer(self.values, np.uint8), np.frombuffer(self.lengths, np.int32))


_kinds: dict[str, Kinds] = {}


def kinds(spark: SparkSession) -> Kinds:
    """What ``SENTENCE_END`` and ``SURFACE_TOKEN`` make of every code point, asked of Spark once per application.

    Spark and Python may know different versions of Unicode.
    """
    app = spark.sparkContext.applicationId
    if app not in _kinds:
        # Behind another character no code point is taken for a mark of the byte order.
        pair = F.concat(F.lit("00000061"), F.lpad(F.hex("id"), 8, "0"))
        c = F.substring(F.decode(F.unhex(pair), "UTF-32"), 2, 1)
        word, sign = X.SURFACE_TOKEN.split("|")
        kind = F.when(c.rlike(X.SENTENCE_END), END).when(c.rlike(word), WORD).when(c.rlike(sign), SIGN).otherwise(BLANK)
        found = spark.range(sys.maxunicode + 1).select("id", kind.cast("byte").alias("kind")).toArrow().sort_by("id")
        table = found["kind"].to_numpy().astype(np.uint8)
        firsts = np.flatnonzero(np.diff(table, prepend=255))
        lengths = np.diff(firsts, append=len(table)).astype(np.int32)
        _kinds[app] = Kinds(lengths.tobytes(), table[firsts].tobytes())
    return _kinds[app]


@dataclass(frozen=True)
class Surface:
    """Tokens of some texts in order, the sentence and place of each, and where each text's tokens begin and end."""

    words: pa.Array
    sent: np.ndarray
    pos: np.ndarray
    starts: np.ndarray


def _in_pieces(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Whole texts, about ``most`` bytes at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first, before = 0, 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield texts[first:last]
        first, before = last, int(ends[last - 1])


def _numbers_within(fresh: np.ndarray) -> np.ndarray:
    """Place of every entry behind the last one that is ``fresh``; the first always is."""
    firsts = np.flatnonzero(fresh)
    return np.arange(len(fresh)) - np.repeat(firsts, np.diff(firsts, append=len(fresh)))


def _cut(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens, their lengths, sentences and places, and the number of tokens of each text."""
    listed = pa.array([t or "" for t in texts.to_pylist()], pa.string()) if texts.null_count else texts
    offsets = np.frombuffer(listed.buffers()[1], np.int32)[listed.offset : listed.offset + len(listed) + 1].astype(np.int64)
    data = listed.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    byte = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    kind = table[points]
    begins = np.searchsorted(byte, offsets - offsets[0])
    fresh = np.ones(len(points) + 1, dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=fresh[1:-1])
    fresh[begins] = True
    runs = np.flatnonzero(fresh[:-1])
    sizes = np.diff(byte[np.append(runs, len(points))])
    of_run = kind[runs]
    token = (of_run == WORD) | (of_run == SIGN)
    text = np.searchsorted(begins, runs[token], side="right") - 1
    ended = np.concatenate([[0], np.cumsum(of_run == END)])
    sent = ended[:-1][token] - ended[np.searchsorted(runs, begins)][text]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (sent[1:] != sent[:-1])
    counts = np.bincount(text, minlength=len(listed))
    return raw[np.repeat(token, sizes)], sizes[token], sent, _numbers_within(new), counts


def surface_tokens(texts: pa.Array, kinds: Kinds) -> Surface:
    """Tokens of an array of texts; null has none."""
    parts = [_cut(part, kinds.table()) for part in _in_pieces(texts, PIECE)]
    if not parts:
        none = np.zeros(0, np.int32)
        return Surface(pa.array([], pa.string()), none, none, np.zeros(1, np.int32))
    data, sizes, sent, pos, counts = (np.concatenate(values) for values in zip(*parts))
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return Surface(words, sent.astype(np.int32), pos.astype(np.int32), starts)


def surface_counts(df: DataFrame, by: str, column: str) -> DataFrame:
    """``by, token, n``: how often each token occurs in the texts of each value of ``by``, a text column.

    A task counts the words of some texts before they are shuffled.
    """
    workers_find_package(df.sparkSession)
    table_of = kinds(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for texts in _in_pieces(batch.column(1), COUNTED):
                found = surface_tokens(texts, table_of)
                of_text = np.repeat(np.arange(first, first + len(texts)), np.diff(found.starts))
                first += len(texts)
                table = pa.table([batch.column(0).take(pa.array(of_text)), found.words], names=["by", "token"])
                counted = table.group_by(["by", "token"]).aggregate([([], "count_all")]).rename_columns(["by", "token", "n"])
                yield from counted.combine_chunks().to_batches()

    counted = df.select(by, column).mapInArrow(count, "by string, token string, n long")
    return counted.groupBy(F.col("by").alias(by), "token").agg(F.sum("n").alias("n"))
