"""Distinct word shingles of whole texts as sorted 63-bit hashes, for batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Bytes of text hashed at once; a longer text is hashed alone.
CHUNK = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_bytes = np.arange(256, dtype=np.uint64)
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + np.uint64(32), _bytes).astype(np.uint8)
BLANK = (_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13))
VALUE = mix((_bytes + np.uint64(1)) * BASE)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    if kind not in _powers or len(_powers[kind]) < n:
        steps = np.full(max(n, CHUNK + 1024), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind][:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of ``data`` (UTF-8), A-Z lowered."""
    raw = LOWER[np.frombuffer(data, np.uint8)]
    edge = np.diff(np.concatenate(([True], BLANK[raw], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(VALUE[raw] * _power("up", BASE, len(raw)), out=sums[1:])
    spans = (sums[ends] - sums[starts]) * _power("down", INVERSE, len(raw) + 1)[starts]
    return mix(spans + (ends - starts).astype(np.uint64) * VALUE[0]), starts


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > CHUNK:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text) + 1
    if part:
        yield part


def shingle_sets(texts: list[str | None], k: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the ``k``-word shingles of every text.

    Fewer than ``k`` words give one shingle of all words; no word, or null, gives an empty set. Hashes are below 2**63, so signed numbers keep their order.
    """
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    weight = VALUE[1 : k + 1]
    for part in _chunks(encoded):
        hashes, starts = word_hashes(b"\n".join(part))
        lengths = np.array([len(t) + 1 for t in part], np.int64)
        cuts = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
        n = max(0, len(hashes) - k + 1)
        grams = np.zeros(n, np.uint64)
        for j in range(k):
            grams += hashes[j : j + n] * weight[j]
        grams = mix(grams) >> np.uint64(1)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                whole = (hashes[a:b] * weight[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix(np.array([whole], np.uint64)) >> np.uint64(1)
            else:
                yield np.empty(0, np.uint64)


def set_keys(grams: np.ndarray) -> tuple[int, int]:
    """Two independent signed 64-bit hashes of a set of hashes."""
    n = np.uint64(len(grams))
    one = mix(np.array([mix(grams).sum(dtype=np.uint64) + n], np.uint64))
    two = mix(np.array([mix(grams ^ VALUE[7]).sum(dtype=np.uint64) ^ VALUE[9]], np.uint64))
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])
