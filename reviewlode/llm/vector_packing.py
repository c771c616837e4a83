"""Packing of examples into sequences under limits on tokens, segments and loss-bearing tokens at once.

Vector bin packing, bin by bin: of the examples at hand that fit what is left of a sequence, the one goes in whose
demands have the largest weighted dot product with what is left, so examples that need much of what is plentiful come
first. Weights are the examples' average demands. Where none fits, an example may be cut so that the sequence fills up.

A task packs its own rows in the order they come and holds a bounded number of them, so nothing is shuffled, no key can
be hot, and a lost task is run again alone. What a task has left at its end is cut into sequences of powers of
two, which need no padding; without cutting, its last sequence may stay open.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlode.llm.common import free, map_arrow
from reviewlode.session import land

# Examples from which a task chooses, and rows that are tokenised at once.
WINDOW = 1024
ROWS = 200


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold at most."""

    tokens: int = 1024
    segments: int = 256
    loss: int = 1024

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits must be positive")


@dataclass
class Example:
    """What is left of a document: ids from ``start`` on, of which those before ``prompt`` bear no loss."""

    doc: object
    ids: bytes
    prompt: int
    start: int = 0

    @property
    def tokens(self) -> int:
        return len(self.ids) // 4 - self.start

    def loss(self, tokens: int) -> int:
        """Loss-bearing ids among the next ``tokens``."""
        return max(0, self.start + tokens - max(self.prompt, self.start))

    @property
    def needs(self) -> tuple[int, int, int]:
        return self.tokens, 1, self.loss(self.tokens)


Piece = tuple[Example, int, int]  # example, first id, number of ids


class Packer:
    """Sequences from a window of examples."""

    def __init__(self, limits: Limits, cut: bool) -> None:
        self.limits, self.cut = limits, cut
        self.window: list[Example] = []
        self.capacity = np.array([limits.tokens, limits.segments, limits.loss], np.float64)

    def offer(self, example: Example) -> Iterator[list[Piece]]:
        """Take an example in; gives the sequences that it fills alone."""
        tokens, loss = self.limits.tokens, self.limits.loss
        while example.tokens > tokens or example.loss(example.tokens) > loss:
            n = min(example.tokens, tokens, max(0, example.prompt - example.start) + loss)
            if self.cut and n < tokens:
                break  # loss-bearing tokens run out first: what is left of the sequence is filled below
            yield [self._take(example, n)]
        if example.tokens:
            self.window.append(example)

    @staticmethod
    def _take(example: Example, n: int) -> Piece:
        piece = (example, example.start, n)
        example.start += n
        return piece

    def _needs(self) -> np.ndarray:
        """(examples, 3): tokens, segments and loss-bearing tokens."""
        return np.array([e.needs for e in self.window], np.int64)

    def sequences(self, least: int) -> Iterator[list[Piece]]:
        """Pack until fewer than ``least`` examples are left, or too little to fill a sequence."""
        while len(self.window) >= max(1, least):
            needs = self._needs()
            alive = np.ones(len(self.window), bool)
            # Examples come out of this window until a half is used; then needs and weights are taken anew.
            weights = needs.mean(axis=0) / self.capacity**3
            while alive.any() and alive.sum() >= max(least, len(alive) // 2 if least else 1):
                if self.cut and not least and needs[alive, 0].sum() < self.limits.tokens:
                    break
                yield self._one(needs, weights, alive)
            used = not alive.all()
            self.window = [e for e, a in zip(self.window, alive.tolist(), strict=True) if a]
            if not used:
                return

    def _one(self, needs: np.ndarray, weights: np.ndarray, alive: np.ndarray, tokens: int | None = None) -> list[Piece]:
        """One sequence; updates what is alive and what cut examples still need."""
        most = self.limits.tokens if tokens is None else tokens
        left = np.array([most, self.limits.segments, self.limits.loss])
        pieces: list[Piece] = []
        while left[0] and left[1] and alive.any():
            fits = alive & (needs <= left).all(axis=1)
            if fits.any():
                i = int(np.where(fits, needs @ (weights * left), -1.0).argmax())
                n = int(needs[i, 0])
            elif self.cut:
                # The example of which the most tokens fit; its prompt comes first.
                able = np.minimum(np.minimum(needs[:, 0], left[0]), needs[:, 0] - needs[:, 2] + left[2])
                i = int(np.where(alive, able, 0).argmax())
                n = int(able[i])
                if not n:
                    break
            else:
                break
            example = self.window[i]
            left -= (n, 1, example.loss(n))
            pieces.append(self._take(example, n))
            needs[i], alive[i] = example.needs, example.tokens > 0
        if self.cut and left[0]:
            self._trim(pieces, int(most - left[0]), needs, alive)
        return pieces

    def _trim(self, pieces: list[Piece], fill: int, needs: np.ndarray, alive: np.ndarray) -> None:
        """Give back what is beyond the greatest power of two, since such a sequence needs no padding."""
        spare = fill - (1 << fill.bit_length() - 1)
        place = {id(e): i for i, e in enumerate(self.window)} if spare else {}
        while spare:
            example, first, n = pieces.pop()
            back = min(n, spare)
            spare -= back
            if n > back:
                pieces.append((example, first, n - back))
            example.start -= back
            i = place[id(example)]
            needs[i], alive[i] = example.needs, True

    def close(self) -> Iterator[list[Piece]]:
        """Pack all that is left."""
        yield from self.sequences(0)
        while self.window:
            needs = self._needs()
            alive = np.ones(len(self.window), bool)
            # Less than a sequence is left: the largest power of two in it is filled next.
            tokens = min(self.limits.tokens, 1 << int(needs[:, 0].sum()).bit_length() - 1) if self.cut else None
            yield self._one(needs, needs.mean(axis=0) / self.capacity**3, alive, tokens)
            self.window = [e for e, a in zip(self.window, alive.tolist(), strict=True) if a]


def pack(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    prompt: str | None = None,
    limits: Limits = Limits(),  # noqa: B008
    cut: bool = True,
    with_ids: bool = False,
) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset) of every piece.

    A row is the ids of ``prompt``, which bear no loss, of ``text``, and an end id 0, which does; null texts are empty. ``path`` is a byte-level BPE file. With ``cut``, rows are cut wherever that fills a
    sequence, and sequences that cannot be filled have a power of two of tokens; else only rows beyond a limit
    are cut. Repeated rows and null keys are packed as often as they are there. Offsets leave no gap. Which rows share a sequence follows from the table's layout. ``with_ids`` adds the ids. An empty
    table gives no piece; other columns are not read.
    """
    made = [("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("doc_tokens", "bigint")]
    made += [("loss_tokens", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint"), ("ids", "array<bigint>")]
    made = made if with_ids else made[:-1]
    name = free([n for n, _ in made], key)
    names = [name, *[n for n, _ in made]]
    kind = docs.schema[key].dataType

    def rows(sequence: int, pieces: list[Piece]) -> Iterator[tuple]:
        offset = 0
        for example, first, n in pieces:
            ids = example.ids[4 * first : 4 * (first + n)]
            bearing = max(0, first + n - max(first, example.prompt))
            row = (example.doc, first, n, zlib.crc32(ids), len(example.ids) // 4, bearing, sequence, offset)
            yield (*row, np.frombuffer(ids, "<u4").astype("i8")) if with_ids else row
            offset += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from reviewlode.llm.byte_tokens import tokenizer

        encode = tokenizer(path)
        end = np.zeros(1, "<u4").tobytes()
        packer = Packer(limits, cut)
        number = TaskContext.get().partitionId() << 36
        out: list[tuple] = []
        types: list[pa.DataType] = []

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            types = [batch.column(0).type] + [pa.int64()] * 7 + [pa.list_(pa.int64())] * with_ids
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = encode([t or "" for t in part.column(1).to_pylist()])
                prompts = encode([t or "" for t in part.column(2).to_pylist()]) if prompt else [b""] * part.num_rows
                for doc, before, ids in zip(part.column(0).to_pylist(), prompts, texts, strict=True):
                    for pieces in packer.offer(Example(doc, before + ids + end, len(before) // 4)):
                        out += rows(number, pieces)
                        number += 1
                if len(packer.window) >= 2 * WINDOW:
                    for pieces in packer.sequences(WINDOW):
                        out += rows(number, pieces)
                        number += 1
                if out:
                    yield batch_of(out)
                    out = []
        for pieces in packer.close():
            out += rows(number, pieces)
            number += 1
            if len(out) > 10 * WINDOW:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    columns = [key, text] + ([prompt] if prompt else [])
    schema = ", ".join(f"`{n}` {t}" for n, t in [(name, kind.simpleString()), *made])
    packed = land(map_arrow(docs.select(*columns), run, schema), "packed")
    return packed.withColumnRenamed(name, key) if name != key else packed


def padding(packed: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """(sequences, tokens, padded): what the sequences hold, and what fills them up unless that is a power of two."""
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    free_of = F.bit_count("n") == 1
    return fill.agg(
        F.count(F.lit(1)).alias("sequences"),
        F.sum("n").alias("tokens"),
        F.sum(F.when(free_of, 0).otherwise(limits.tokens - F.col("n"))).alias("padded"),
    )
