"""Context-tree weighting over bytes: counts in a tree of contexts, mixed across all depths.

Every byte is eight binary decisions; a decision is a node of the byte's binary tree. For each decision there is
a tree of contexts, the bytes before, nearest first, up to a depth. A node's estimate is Krichevsky-Trofimov's;
a node is worth the even mix of its own estimate and the product of its children. The weights that this
gives for whole training data are kept, and a byte's probability mixes the estimates along its context path by
them. A *gram* is a context of full depth and the byte that follows, packed into one number, nearest byte on top,
so that all grams of one subtree are one range of numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LOG_HALF, LOG_PI = np.log(0.5), np.log(np.pi)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END = 10  # byte of the end token; also what stands before a text
SHIFT = 9.0


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 0.5, by Stirling's series beyond a shift."""
    low = np.ones_like(x)
    for i in range(int(SHIFT)):
        low *= x + i
    x = x + SHIFT
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - np.log(low)


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - LOG_PI - log_gamma(zeros + ones + 1.0)


@dataclass
class Nodes:
    """Decisions seen in contexts of one depth: sorted ids (context, decision), counts, weights."""

    ids: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    worth: np.ndarray  # log of the weighted probability
    own: np.ndarray  # weight of the node's own estimate against its children's


def decisions(grams: np.ndarray, depth: int, full: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(node id, bit) of the eight decisions of every gram in its context of ``depth`` bytes."""
    byte = grams & 255
    context = (grams >> (8 * (full - depth + 1))) << 8
    return [(context | (1 << level) | (byte >> (8 - level)), (byte >> (7 - level)) & 1) for level in range(8)]


def _gather(ids: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    kinds, at = np.unique(ids, return_inverse=True)
    return kinds, *[np.bincount(at, weights=v, minlength=len(kinds)) for v in values]


def weigh(ids: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> Nodes:
    """Nodes from their counts and the sum of their children's worth (None at full depth)."""
    own = log_estimate(zeros, ones)
    if below is None:
        return Nodes(ids, zeros, ones, own, np.ones(len(ids)))
    worth = np.logaddexp(LOG_HALF + own, LOG_HALF + below)
    return Nodes(ids, zeros, ones, worth, np.exp(LOG_HALF + own - worth))


def lift(nodes: Nodes) -> Nodes:
    """The parents of nodes, one context byte shorter."""
    parents = ((nodes.ids >> 16) << 8) | (nodes.ids & 255)
    return weigh(*_gather(parents, nodes.zeros, nodes.ones, nodes.worth))


def subtree(grams: np.ndarray, counts: np.ndarray, full: int, least: int) -> dict[int, Nodes]:
    """Nodes of depths ``least`` to ``full`` from gram counts; all grams of a context of ``least`` bytes are here."""
    seen = counts > 0
    parts = decisions(grams[seen], full, full)
    ids = np.concatenate([i for i, _ in parts])
    bits = np.concatenate([b for _, b in parts])
    n = np.tile(counts[seen].astype(float), 8)
    kinds, zeros, ones = _gather(ids, n * (1 - bits), n * bits)
    nodes = {full: weigh(kinds, zeros, ones, None)}
    for depth in range(full - 1, least - 1, -1):
        nodes[depth] = lift(nodes[depth + 1])
    return nodes


def log_probability(grams: np.ndarray, full: int, nodes: dict[int, Nodes]) -> np.ndarray:
    """log10 of every gram's last byte given its context; ``nodes`` of depths 0 to ``full``."""
    total = np.zeros(len(grams))
    paths = {d: decisions(grams, d, full) for d in nodes}
    for level in range(8):
        p = np.full(len(grams), 0.5)
        for depth in range(full, -1, -1):
            at = nodes.get(depth)
            if at is None or not len(at.ids):
                continue
            ids, bits = paths[depth][level]
            i = np.minimum(np.searchsorted(at.ids, ids), len(at.ids) - 1)
            hit = at.ids[i] == ids
            i, bit = i[hit], bits[hit]
            own = (np.where(bit == 1, at.ones[i], at.zeros[i]) + 0.5) / (at.zeros[i] + at.ones[i] + 1.0)
            p[hit] = at.own[i] * own + (1 - at.own[i]) * p[hit]
        total += np.log10(p)
    return total


def code(text: str | None) -> tuple[bytes, int]:
    """The bytes that stand for a text, and its tokens: words in lower case, one blank between, an end."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    return b" ".join(words) + bytes([END]), len(words) + 1


def grams_of(coded: list[bytes], full: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all bytes of several coded texts, and where each text's begin."""
    pad = bytes([END]) * full
    data = np.frombuffer(b"".join(pad + c for c in coded), np.uint8).astype(np.int64)
    lengths = np.array([len(c) for c in coded], np.int64)
    grams = np.zeros(max(0, len(data) - full), np.int64)
    for back in range(1, full + 1):  # nearest byte on top
        grams = (grams << 8) | data[full - back : len(data) - back]
    grams = (grams << 8) | data[full:]
    starts = np.concatenate(([0], np.cumsum(lengths + full)[:-1]))
    keep = np.ones(len(grams), bool)
    # Bytes of the padding between texts are no events.
    for j in range(full):
        keep[starts[1:] - full + j] = False
    return grams[keep], np.concatenate(([0], np.cumsum(lengths)[:-1]))


class Lookup:
    """Values of keys in tables without chains: what a slot cannot hold goes to the next, smaller table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.tables = []
        while len(keys):
            bits = max(4, (2 * len(keys)).bit_length())
            slots = self._slots(keys, bits, len(self.tables))
            held = np.full(1 << bits, -1, np.int64)
            held[slots] = np.arange(len(keys))
            placed = held[slots] == np.arange(len(keys))
            names, found = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
            names[slots[placed]], found[slots[placed]] = keys[placed], values[placed]
            self.tables.append((bits, names, found))
            keys, values = keys[~placed], values[~placed]

    @staticmethod
    def _slots(keys: np.ndarray, bits: int, turn: int) -> np.ndarray:
        spread = (keys.view(np.uint64) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
        return ((spread ^ (spread >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none), and which keys are held."""
        out, hit = np.zeros(len(keys)), np.zeros(len(keys), bool)
        left = np.arange(len(keys))
        for turn, (bits, names, found) in enumerate(self.tables):
            mine = keys[left] if turn else keys
            slots = self._slots(mine, bits, turn)
            ok = names[slots] == mine
            out[left[ok]], hit[left[ok]] = found[slots[ok]], True
            left = left[~ok]
            if not len(left):
                break
        return out, hit
