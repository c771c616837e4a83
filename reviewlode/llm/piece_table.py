"""Piece tables over UTF-8 texts: descriptors of immutable buffers, cut, permuted, streamed and never copied.

A *piece* is (buffer, start, end) in bytes. Buffers are texts and sentinels as they came; cutting a table
splits descriptors, an arrangement permutes them, and the inverse permutation gives back the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np

Piece = tuple[int, int, int]

# Bytes looked at at once when code points are counted.
BLOCK = 1 << 20


def code_points(data: memoryview) -> int:
    """Number of code points of UTF-8 bytes."""
    raw = np.frombuffer(data, np.int8)  # bytes that continue a code point are below -64
    return sum(int(np.count_nonzero(raw[a : a + BLOCK] >= -64)) for a in range(0, len(raw), BLOCK))


def byte_places(data: memoryview, n: int, places: Sequence[int]) -> list[int]:
    """Byte offsets of ascending places, counted in code points of the ``n`` that ``data`` has."""
    if n == len(data):
        return list(places)
    raw = np.frombuffer(data, np.int8)
    out: list[int] = []
    seen = at = 0
    starts = np.empty(0, np.int64)
    for place in places:
        while place >= seen + len(starts) and at < len(raw):
            seen += len(starts)
            starts = np.flatnonzero(raw[at : at + BLOCK] >= -64) + at
            at += BLOCK
        out.append(int(starts[place - seen]) if place < n else len(raw))
    return out


def cut(pieces: list[Piece], places: Sequence[int]) -> list[Piece]:
    """Split the descriptors at ascending byte places of the table's text; empty pieces stay as such."""
    out, before, left = [], 0, list(places)
    for buffer, start, end in pieces:
        while left and left[0] <= before + end - start:
            middle = start + left.pop(0) - before
            out.append((buffer, start, middle))
            before += middle - start
            start = middle
        out.append((buffer, start, end))
        before += end - start
    return out


def arrange(pieces: list[Piece], order: Sequence[int]) -> list[Piece]:
    """The descriptors in another order."""
    return [pieces[i] for i in order]


def inverse(order: Sequence[int]) -> list[int]:
    """The order that undoes ``order``."""
    out = [0] * len(order)
    for place, i in enumerate(order):
        out[i] = place
    return out


def stream(pieces: list[Piece], buffers: Sequence[memoryview]) -> Iterator[memoryview]:
    """The bytes of a table, piece by piece, without a copy."""
    for buffer, start, end in pieces:
        yield buffers[buffer][start:end]


def sha256(pieces: list[Piece], buffers: Sequence[memoryview]) -> str:
    """Digest of a table's text, fed from its descriptors."""
    digest = hashlib.sha256()
    for part in stream(pieces, buffers):
        digest.update(part)
    return digest.hexdigest()
