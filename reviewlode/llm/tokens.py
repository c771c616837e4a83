"""Token ids of whole texts by a public tokenizer file, with a cache of words."""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer

# Words a worker remembers; later ones are encoded again wherever they occur.
CACHE_WORDS = 1_200_000
# Plain texts: no character that the file's own rules normalise in more ways than to lower case.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-įı-ž]*")
LETTERS = "a-z\xc0-\xd6\xd8-\xf6\xf8-ž"
# How the file's own rules split a lower-case plain text.
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\\s0-9{LETTERS}]+")
SPECIAL = "<|"


class WordTokenizer:
    """Ids of texts by a BPE file whose tokens never cross a blank and whose case is lowered.

    Only plain texts take the way over the word cache; all others go to the tokenizer as they are.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words, all encoded as one text and cut at the words' starts."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        cuts = np.searchsorted(np.array([a for a, _ in found.offsets], np.int64), starts).tolist()
        return {w: ids[cuts[i] : cuts[i + 1]].tobytes() for i, w in enumerate(words)}

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words not known yet; words that differ in punctuation only are encoded once."""
        parts = {w: SPLIT.findall(w) for w in words}
        known = self.known
        new = list({p for ps in parts.values() for p in ps if p not in known})
        made: dict[str, bytes] = {}
        for at in range(0, len(new), 5000):
            made |= self._encode(new[at : at + 5000])
        for word, ps in parts.items():
            if word not in made:
                made[word] = b"".join([known[p] if p in known else made[p] for p in ps])
        return made

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit numbers."""
        plain = [SPECIAL not in t and PLAIN.fullmatch(t) is not None for t in texts]
        parts = [t.lower().split() if p else [] for t, p in zip(texts, plain, strict=True)]
        known = self.known
        new = self._learn({w for p in parts for w in p}.difference(known))
        if len(known) < CACHE_WORDS:
            known.update(new)
            new = {}
        out = []
        for text, words, p in zip(texts, parts, plain, strict=True):
            if not p:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out.append(np.array(ids, "<u4").tobytes())
            elif new:
                out.append(b"".join([known[w] if w in known else new[w] for w in words]))
            else:
                out.append(b"".join([known[w] for w in words]))
        return out


_open: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a file, opened once."""
    if path not in _open:
        _open[path] = WordTokenizer(path)
    return _open[path]
