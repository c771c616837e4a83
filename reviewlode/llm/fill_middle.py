"""Fill-in-the-middle examples from whole texts, by piece tables.

A text is one descriptor. Two cuts split it into prefix, middle and suffix; sentinels are descriptors of a
second buffer; the forms are permutations of the five or six pieces:

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
* ``plain``: the text as it is

Cuts and forms follow from a hash of the id and a seed, so reruns agree. ``restore`` finds the sentinels of an
output, makes its piece table and applies the inverse permutation. Both steps are local to a row: no shuffle, and
a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from reviewlode.llm import piece_table as pieces
from reviewlode.llm.common import free, map_arrow

SENTINELS = (b"<P>", b"<S>", b"<M>")
MARKS = memoryview(b"".join(SENTINELS))
# Descriptors of the sentinels in their buffer.
P, S, M = ((1, 0, 3), (1, 3, 6), (1, 6, 9))
# Order of (P, prefix, S, suffix, M, middle) pieces in a form.
ORDERS = {"psm": (0, 1, 2, 3, 4, 5), "spm": (2, 3, 0, 1, 4, 5)}
SEED = 1
PLAIN_PERCENT, SPM_PERCENT = 10, 20
# Rows of an Arrow batch whose outputs are held at once.
ROWS = 200


def _numbers(key: object, seed: int) -> list[int]:
    name = f"{seed}:{'' if key is None else key}".encode()
    digest = hashlib.sha256(name).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def split(data: memoryview, key: object, seed: int, plain: int, spm: int) -> tuple[int, str, list[int], list[pieces.Piece]]:
    """(code points, form, lengths in code points of prefix, middle and suffix, piece table) of a text."""
    n = pieces.code_points(data)
    whole = [(0, 0, len(data))]
    h1, h2, h3, h4 = _numbers(key, seed)
    text = data.tobytes()
    if not n or h3 % 100 >= 100 - plain or any(s in text for s in SENTINELS):
        return n, "plain", [], whole
    form = "spm" if h4 % 100 < spm else "psm"
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = pieces.cut(whole, pieces.byte_places(data, n, (low, high)))
    table = pieces.arrange([P, prefix, S, suffix, M, middle], ORDERS[form])
    return n, form, [low, high - low, n - high], table


def parse(data: memoryview, form: str) -> list[pieces.Piece]:
    """Piece table of the text that an output of ``form`` was made of, over the output."""
    if form == "plain":
        return [(0, 0, len(data))]
    raw = data.tobytes()
    order = ORDERS[form]
    marks = [SENTINELS[i // 2] for i in order if i % 2 == 0]
    ends, at = [], 0
    starts = []
    for mark in marks:  # the text holds no sentinel, so the first one found is the one put there
        at = raw.index(mark, at)
        ends.append(at)
        at += len(mark)
        starts.append(at)
    found = [(0, start, end) for start, end in zip(starts, [*ends[1:], len(raw)], strict=True)]
    # found: the three texts as they stand in the output; put them back as prefix, suffix, middle.
    stand = [i // 2 for i in order if i % 2]
    prefix, suffix, middle = pieces.arrange(found, pieces.inverse(stand))
    return [prefix, middle, suffix]


def _views(column: pa.Array) -> Iterator[memoryview | None]:
    """The values of a string column as views of its buffer."""
    for value in column.cast(pa.large_binary()):
        yield memoryview(value.as_buffer()) if value.is_valid else None


def _map(df: DataFrame, fields: list[tuple[str, str]], make: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """Apply ``make`` to Arrow batches of a few rows; it gives arrays in the order of ``fields`` (name, type)."""
    names = [name for name, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield pa.RecordBatch.from_arrays(make(batch.slice(at, ROWS)), names=names)

    return map_arrow(df, run, ", ".join(f"`{name}` {kind}" for name, kind in fields))


def fill_middle(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    plain: int = PLAIN_PERCENT,
    spm: int = SPM_PERCENT,
) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output, output_sha256) of every row of ``docs``.

    ``plain`` per cent of all texts stay as they are, and so do empty and null texts (their output is empty) and
    texts that hold a sentinel; ``spm`` per cent of the others put the suffix first. Cuts lie between code points. Rows
    that repeat an id are cut by the same numbers; a null id counts as an empty one. Other columns are not read, and
    an empty table gives no row.
    """
    fields = [("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint")]
    fields += [("output", "string"), ("output_sha256", "string")]
    name = free([n for n, _ in fields], key)  # the key may be named like a column made here
    fields.insert(0, (name, docs.schema[key].dataType.simpleString()))

    def make(batch: pa.RecordBatch) -> list:
        n, forms, prefixes, middles, outputs, digests = [], [], [], [], [], []
        for id_, data in zip(batch.column(0).to_pylist(), _views(batch.column(1)), strict=True):
            data = memoryview(b"") if data is None else data
            size, form, lengths, table = split(data, id_, seed, plain, spm)
            buffers = (data, MARKS)
            n.append(size)
            forms.append(form)
            prefixes.append(lengths[0] if lengths else None)
            middles.append(lengths[1] if lengths else None)
            outputs.append(b"".join(pieces.stream(table, buffers)))
            digests.append(pieces.sha256(table, buffers))
        long = pa.int64()
        texts = pa.array(outputs, pa.binary()).view(pa.string())
        lengths = [pa.array(x, long) for x in (prefixes, middles)]
        return [batch.column(0), pa.array(n, long), pa.array(forms, pa.string()), *lengths, texts, pa.array(digests, pa.string())]

    return _map(docs.select(key, text), fields, make)


def restore(made: DataFrame, form: str = "form", output: str = "output", with_text: bool = True) -> DataFrame:
    """``made`` with ``restored`` and ``restored_sha256``, the text that every output was made of, in place of ``output``.

    Reads nothing but outputs and forms. Without ``with_text`` only the digest is added. A null output or form gives null.
    """
    kept = [f for f in made.schema.fields if f.name != output]
    fields = [(f.name, f.dataType.simpleString()) for f in kept]
    added = ["restored", "restored_sha256"][0 if with_text else 1 :]
    fields += [(free([f.name for f in kept], n), "string") for n in added]
    at_form = [f.name for f in kept].index(form)

    def make(batch: pa.RecordBatch) -> list:
        texts, digests = [], []
        for data, kind in zip(_views(batch.column(len(kept))), batch.column(at_form).to_pylist(), strict=True):
            table = None if data is None or kind is None else parse(data, kind)
            texts.append(None if table is None or not with_text else b"".join(pieces.stream(table, (data,))))
            digests.append(None if table is None else pieces.sha256(table, (data,)))
        out = [batch.column(i) for i in range(len(kept))]
        return out + [pa.array(texts, pa.binary()).view(pa.string())] * with_text + [pa.array(digests, pa.string())]

    return _map(made.select(*[f"`{f.name}`" for f in kept], f"`{output}`"), fields, make)
