"""Packing of documents into sequences of fixed capacity by linear grouping and best fit.

Only documents longer than a sequence are cut. Pieces that fill a sequence stand alone. For the others the
number of pieces per length is all that planning needs, at most ``capacity`` numbers:

1. Large lengths are sorted and split into groups of equal numbers of pieces; a group counts as its longest.
2. Few sizes allow few configurations of a sequence. The fullest configuration that holds the largest size left
   is used as often as the groups allow, then the next one, until all large pieces are placed.
3. Actual lengths take the places of their group's size in order, so a run of equal sequences stays a run.
4. Small pieces go into what is left by best fit, largest first, and open new sequences where nothing fits.

The plan is a list of runs: pieces of one length, by rank, in consecutive sequences at one offset. It is bounded
by the capacity and the number of groups, never by the documents, and ranks come from counts per length and
hash slice, so no length is sorted or gathered as a whole.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlode.llm.common import free, map_arrow, small
from reviewlode.session import land

CAPACITY = 2048
GROUPS = 600
# Lengths from this share of the capacity on are large.
LARGE = 1 / 16
# Slices of every length by hash, within which pieces are ranked.
SLICES = 64

Run = tuple[int, int, int, int, int]  # length, first rank, pieces, first sequence, offset


def _groups(counts: np.ndarray, least: int, groups: int) -> list[tuple[int, list[list[int]]]]:
    """(size, [[length, rank, pieces], ...]) of every group of large lengths, longest first."""
    total = int(counts[least:].sum())
    share = -(-total // groups) if total else 0
    out: list[tuple[int, list[list[int]]]] = []
    room = 0
    for length in range(len(counts) - 1, least - 1, -1):
        rank, left = 0, int(counts[length])
        while left:
            if not room:
                out.append((length, []))
                room = share
            n = min(room, left)
            out[-1][1].append([length, rank, n])
            rank, left, room = rank + n, left - n, room - n
    return out


def _fullest(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many pieces of every group make the fullest sequence around a piece of the largest size left.

    Larger pieces come first where the fill is equal, so that small ones stay for later gaps.
    """
    lead = next(g for g, n in enumerate(left) if n)
    capacity -= sizes[lead]
    left = [n - (g == lead) for g, n in enumerate(left)]
    reach = np.full(capacity + 1, -1, np.int64)  # group that reached a fill last
    reach[0] = len(sizes)
    before = np.zeros(capacity + 1, np.int64)
    for g, (size, n) in enumerate(zip(sizes, left, strict=True)):
        for _ in range(min(n, capacity // size)):
            new = np.flatnonzero((reach[: capacity + 1 - size] >= 0) & (reach[size:] < 0)) + size
            if not len(new):
                break
            before[new], reach[new] = new - size, g
        if reach[capacity] >= 0:
            break
    used = [0] * len(sizes)
    used[lead] = 1
    fill = int(np.flatnonzero(reach >= 0)[-1])
    while fill:
        used[reach[fill]] += 1
        fill = int(before[fill])
    return used


def plan(counts: list[int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> list[Run]:
    """Runs that place ``counts[length]`` pieces of every length below ``capacity``."""
    counts = np.asarray(counts, np.int64)
    least = max(1, int(capacity * large))
    grouped = _groups(counts, least, groups)
    sizes, queues = [s for s, _ in grouped], [q for _, q in grouped]
    left = [sum(n for _, _, n in q) for q in queues]
    runs: list[Run] = []
    holes: dict[int, list[tuple[int, int]]] = {}  # room left → (first sequence, sequences)
    top = 0
    while any(left):
        used = _fullest(sizes, left, capacity)
        times = min(n // u for n, u in zip(left, used, strict=True) if u)
        places = [g for g, u in enumerate(used) for _ in range(u)]
        for g in set(places):
            left[g] -= used[g] * times
        # Every place takes its own stretch of the group's pieces; stretches break where lengths change.
        stretches = []
        for g in places:
            stretch, wanted = [], times
            while wanted:
                length, rank, n = queues[g][0]
                n = min(n, wanted)
                stretch.append((length, rank, n))
                wanted -= n
                queues[g][0] = [length, rank + n, queues[g][0][2] - n]
                if not queues[g][0][2]:
                    queues[g].pop(0)
            stretches.append(stretch)
        ends = sorted({e for s in stretches for e in np.cumsum([n for _, _, n in s]).tolist()})
        at = [0] * len(stretches)
        done = [0] * len(stretches)
        start = 0
        for end in ends:
            offset = 0
            for i, stretch in enumerate(stretches):
                length, rank, n = stretch[at[i]]
                runs.append((length, rank + start - done[i], end - start, top + start, offset))
                offset += length
                if done[i] + n == end:
                    at[i], done[i] = at[i] + 1, end
            holes.setdefault(capacity - offset, []).append((top + start, end - start))
            start = end
        top += times
    rooms = sorted(r for r in holes if r > 0)
    for length in range(least - 1, 0, -1):
        rank, wanted = 0, int(counts[length])
        while wanted:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                # As many new sequences as these pieces fill.
                n = -(-wanted // (capacity // length))
                holes.setdefault(capacity, []).append((top, n))
                rooms.append(capacity)
                top += n
                continue
            room = rooms[i]
            first, n = holes[room].pop()
            if not holes[room]:
                rooms.pop(i)
                del holes[room]
            put = min(n, wanted)
            runs.append((length, rank, put, first, capacity - room))
            if n > put:
                _leave(holes, rooms, room, (first + put, n - put))
            _leave(holes, rooms, room - length, (first, put))
            rank, wanted = rank + put, wanted - put
    return runs


def _leave(holes: dict, rooms: list[int], room: int, run: tuple[int, int]) -> None:
    if room <= 0:
        return
    if room not in holes:
        holes[room] = []
        rooms.insert(bisect_left(rooms, room), room)
    holes[room].append(run)


def pieces(docs: DataFrame, path: str, key: str, text: str, capacity: int, with_ids: bool) -> DataFrame:
    """(doc, piece, start, length, ids_crc32, and ids if asked for) of every row, end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from reviewlode.llm.tokens import tokenizer

        encode = tokenizer(path)
        end = np.zeros(1, "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                made = [x + end for x in encode([t or "" for t in part.column(1).to_pylist()])]
                numbers = [len(x) // 4 for x in made]
                cuts = [(i, s) for i, n in enumerate(numbers) for s in range(0, n, capacity)]
                chunks = [made[i][4 * s : 4 * (s + capacity)] for i, s in cuts]
                columns = [
                    part.column(0).take(pa.array([i for i, _ in cuts], pa.int32())),
                    pa.array([s // capacity for _, s in cuts], pa.int32()),
                    pa.array([s for _, s in cuts], pa.int64()),
                    pa.array([len(c) // 4 for c in chunks], pa.int64()),
                    pa.array([zlib.crc32(c) for c in chunks], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(c, "<u4").astype("i8") for c in chunks], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    schema = f"doc {docs.schema[key].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return map_arrow(docs.select(key, text), run, schema + ", ids array<bigint>" * with_ids)


def pack(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece; ``with_ids`` adds the ids.

    A document is the ids of its whole text and an end id 0, so null and empty texts are one id. Repeated
    rows are packed as often as they are there. Places within a sequence leave no gap. An empty table gives
    no piece. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    cut = pieces(docs, path, key, text, capacity, with_ids)
    cut = land(cut.withColumn("slice", F.pmod(F.xxhash64("doc", "piece", "ids_crc32"), F.lit(SLICES))), "pieces")
    sliced = land(cut.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = [0] * (capacity + 1)
    for row in sliced.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        counts[row["length"]] = row["n"]
    runs = plan(counts[:capacity], capacity)
    top = max((first + n for _, _, n, first, _ in runs), default=0)
    runs += [(capacity, 0, counts[capacity], top, 0)] if counts[capacity] else []
    # Rank of a piece among those of its length: pieces in earlier slices, then its place in its own.
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("length", "slice").orderBy("doc", "piece", "ids_crc32")
    columns = [c for c in cut.columns if c != "slice"]
    ranked = cut.select("doc", "piece", "ids_crc32", "length", "start", "slice").withColumn("at", F.row_number().over(within) - 1)
    ranked = ranked.join(small(starts), ["length", "slice"]).withColumn("rank", F.col("earlier") + F.col("at"))
    # A run list per length, few and bounded by the plan; a piece finds its run by its rank.
    schema = "length bigint, first bigint, n bigint, sequence bigint, offset bigint"
    table = spark.createDataFrame(runs, schema)
    table = table.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "n", "sequence", "offset"))).alias("runs"))
    placed = ranked.join(F.broadcast(table), "length").withColumn(
        "run", F.expr("filter(runs, r -> r.first <= rank and rank < r.first + r.n)[0]")
    )
    sequence = (F.col("run.sequence") + F.col("rank") - F.col("run.first")).alias("sequence_id")
    placed = placed.select("doc", "piece", "start", "length", "ids_crc32", sequence, F.col("run.offset").alias("offset"))
    if not with_ids:
        return placed.withColumnRenamed("doc", key)
    # Pieces that agree in document, place and content are the same ids.
    names = ["doc", "piece", "ids_crc32"]
    ids = cut.select(*[F.col(c).alias(f"of_{c}") for c in names], "ids").dropDuplicates([f"of_{c}" for c in names])
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in names]
    out = placed.join(ids, same[0] & same[1] & same[2], "left")
    return out.select(*placed.columns, "ids").withColumnRenamed("doc", key)
