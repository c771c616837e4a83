"""Codes of vectors by product quantisation, with codebooks from ball k-means in whole numbers.

A vector is cut into equal parts, and every part position has a codebook. A round assigns each part to its nearest
entry and moves entries to their parts' means. The first round compares with all entries. Later rounds start from the
part's last entry and need few distances, all results being those of the full comparison:

* an entry's *ball* reaches its farthest part, known from the last round and the entry's own move;
* entries that are not within twice that radius are no *neighbours* and never win;
* parts within half the way to the nearest neighbour are in the *stable core* and stay;
* any other part lies in an *annular ring* and meets only neighbours within twice its distance from its entry.

Rows stay in their tasks. A task sends one row per part and entry: counts, sums and the farthest distance, so what
reaches the driver is bounded by the codebooks' size. A round's codes are a stored table, so a lost executor
costs its tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlode.llm.common import discard, map_arrow, small
from reviewlode.session import land

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
# Whole numbers are held within this bound, so that squared distances and their sums fit into 64 bits.
BOUND = 1 << 24
# Vectors whose distances are held at once.
ROWS = 2048


def usable(vector: Column) -> Column:
    """Vectors without a null or non-finite component."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(broken, F.lit(True))


def whole_numbers(vector: Column, scale: int, bound: int) -> Column:
    """Components times ``scale``, rounded down and held within ``bound``."""
    floor = lambda x: F.floor(x.cast("double") * float(scale))
    return F.transform(vector, lambda x: F.greatest(F.lit(-bound), F.least(F.lit(bound), floor(x))).cast("int"))


def _matrix(vectors: pa.Array, parts: int) -> np.ndarray:
    """(rows, parts, width) of a column of lists of one length."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(vectors), parts, -1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


def nearest(values: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest of all entries; the lower index of ties."""
    kind = np.float64 if max(np.abs(values).max(initial=0), np.abs(entries).max(initial=0)) < 1 << 22 else np.int64
    a, b = values.astype(kind), entries.astype(kind)  # below that bound every double here is a whole number
    far = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    index = far.argmin(axis=1)
    return index, far[np.arange(len(far)), index].astype(np.int64)


class Balls:
    """One part position's entries with their neighbours, nearest first."""

    def __init__(self, entries: np.ndarray, reach: np.ndarray) -> None:
        """``reach``: for every entry a bound of its parts' distances."""
        self.entries = entries
        apart = _squares(entries[:, None], entries[None, :])
        np.fill_diagonal(apart, -1)
        self.order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        self.neighbours = (self.apart <= 4 * reach[:, None] ** 2).sum(axis=1)

    def nearest(self, values: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry, from the entries the values had before."""
        best = _squares(values, self.entries[codes])
        index = codes.copy()
        limit = 4 * best
        ring = np.flatnonzero(limit >= self.apart[codes, 0]) if self.apart.shape[1] else np.empty(0, np.int64)
        if not len(ring):
            return index, best
        own = codes[ring]
        # How many neighbours, nearest first, lie within twice the distance.
        number = np.minimum((self.apart[own] <= limit[ring][:, None]).sum(axis=1), self.neighbours[own])
        ring, own, number = ring[number > 0], own[number > 0], number[number > 0]
        if not len(ring):
            return index, best
        starts = np.concatenate(([0], np.cumsum(number)[:-1]))
        at = np.arange(number.sum()) - np.repeat(starts, number)
        candidate = self.order[np.repeat(own, number), at]
        far = _squares(values[np.repeat(ring, number)], self.entries[candidate])
        low = np.minimum.reduceat(far, starts)
        first = np.minimum.reduceat(np.where(far == np.repeat(low, number), candidate, len(self.entries)), starts)
        closer = (low < best[ring]) | ((low == best[ring]) & (first < own))
        index[ring[closer]], best[ring[closer]] = first[closer], low[closer]
        return index, best


def _assign(rows: DataFrame, books: np.ndarray, balls: list[Balls] | None) -> DataFrame:
    """``rows`` with new ``codes`` and ``far``, the squared distances summed over parts."""
    columns = [c for c in rows.columns if c not in ("codes", "far")]
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                values = _matrix(batch.column("q"), parts)
                codes, far = np.empty((len(values), parts), np.uint8), np.zeros(len(values), np.int64)
                old = None
                if balls:
                    joined = b"".join(batch.column("codes").to_pylist())
                    old = np.frombuffer(joined, np.uint8).reshape(-1, parts).astype(np.int64)
                for p in range(parts):
                    found = nearest(values[:, p], books[p]) if old is None else balls[p].nearest(values[:, p], old[:, p])
                    codes[:, p] = found[0]
                    far += found[1]
                out = [batch.column(c) for c in columns]
                out += [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(far)]
                yield pa.RecordBatch.from_arrays(out, names=[*columns, "codes", "far"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return map_arrow(rows, run, f"{schema}, codes binary, far bigint")


def _move(rows: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New codebooks, the floors of the means, and a bound of every ball's radius."""
    parts, entries, width = books.shape
    names = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), np.int64)
        most = np.zeros((parts, entries), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                values = _matrix(batch.column(0), parts)
                codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
                for p in range(parts):
                    own = codes[:, p].astype(np.int64)
                    count[p] += np.bincount(own, minlength=entries)
                    np.add.at(sums[p], own, values[:, p])
                    np.maximum.at(most[p], own, _squares(values[:, p], books[p][own]))
        used = np.argwhere(count > 0)
        columns = [used[:, 0], used[:, 1], count[count > 0], most[count > 0]]
        columns += [sums[:, :, i][count > 0] for i in range(width)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "n", "most", *names])

    schema = ", ".join(f"{c} bigint" for c in ("part", "entry", "n", "most", *names))
    found = map_arrow(rows.select("q", "codes"), run, schema).groupBy("part", "entry")
    found = found.agg(F.sum("n").alias("n"), F.max("most").alias("most"), *[F.sum(c).alias(c) for c in names])
    moved, reach = books.copy(), np.zeros((parts, entries), np.int64)
    for row in found.collect():  # one row per part and entry at most
        at = row["part"], row["entry"]
        moved[at] = [row[c] // row["n"] for c in names]
        # Farthest part from the old place, and the way from there.
        way = int(_squares(moved[at], books[at]))
        reach[at] = int(np.sqrt(row["most"])) + int(np.sqrt(way)) + 4
    return moved, reach


def first_books(rows: DataFrame, key: str, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width): the vectors of the smallest ids, nulls last, equal ids by their numbers."""
    first = rows.select(key, "q").orderBy(F.col(key).asc_nulls_last(), "q").limit(entries)
    vectors = [row["q"] for row in first.collect()]  # bounded by ``entries``
    width = len(vectors[0]) // parts if vectors else 0
    return np.array(vectors, np.int64).reshape(len(vectors), parts, width).transpose(1, 0, 2).copy()


def compress(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """(key, label, codes binary, far bigint) of every usable row, and the codebooks (parts, entries, width).

    A code is a byte per part, so ``entries`` is 256 at most; fewer rows than ``entries`` make as many entries.
    Rows whose vector is null or holds null, NaN or infinite components are dropped. Vectors must be of one
    length, that of the smallest id's first usable vector which ``parts`` divides; rows of another length are
    dropped too. Whole numbers beyond ``BOUND`` count as the bound. Repeated rows count as often as they are
    there; a null id comes after all others. Other columns are not read. An empty table gives no row and
    codebooks without entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte per part: entries must be from 1 to 256")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    rows = rows.where(usable(F.col("v")) & (F.size("v") > 0) & (F.size("v") % parts == 0))
    rows = land(rows.select("id", "label", whole_numbers(F.col("v"), scale, BOUND).alias("q")), "vectors")
    widths = rows.select(F.size("q").alias("n")).distinct().limit(2).collect()
    if len(widths) > 1:
        n = rows.orderBy(F.col("id").asc_nulls_last(), "q").select(F.size("q")).first()[0]
        rows = rows.where(F.size("q") == n)
    books = first_books(rows, "id", parts, entries)
    named = [F.col("id").alias(key), F.col("label").alias(label), "codes", "far"]
    if not books.size:
        empty = rows.withColumn("codes", F.lit(b"")).withColumn("far", F.lit(0).cast("bigint"))
        return empty.select(*named), books
    balls: list[Balls] | None = None
    stored = [rows]
    for _ in range(rounds):
        rows = land(_assign(rows, books, balls), "codes")
        books, reach = _move(rows, books)
        balls = [Balls(b, r) for b, r in zip(books, reach, strict=True)]
        discard(spark, *stored)
        stored = [rows]
    last = land(_assign(rows, books, balls).drop("q"), "codes")
    discard(spark, *stored)
    return last.select(*named), books


def codebooks_digest(books: np.ndarray) -> str:
    """sha256 of all entries' components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def label_errors(codes: DataFrame, label: str = "label") -> DataFrame:
    """``codes`` with ``label_error``: ``far`` summed over equal labels, nulls together."""
    sums = land(codes.groupBy(F.col(label).alias("of")).agg(F.sum("far").alias("label_error")), "label-errors")
    return codes.join(small(sums), F.col(label).eqNullSafe(F.col("of"))).drop("of")
