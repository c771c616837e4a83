"""Token ids of whole texts by a byte-level BPE file, with a cache of words.

Such a file splits a text by its own pattern before merging bytes. A blank run's last blank goes with the word behind
it, so a text may be cut before every word's blank, and at both ends of other blank runs, without a change of ids.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np

# Words a worker remembers; later ones are encoded again wherever they occur.
CACHE = 600_000
# Words with their blank, blank runs without the last blank before a word, and that blank if it is none of a word's.
STRETCH = re.compile(r" ?\S+|\s+(?!\S)|\s")
# Blanks other than spaces and line ends.
BLANKS = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# Separators that are blanks here but not to the file's pattern.
OTHER_BLANKS = "\x1c", "\x1d", "\x1e", "\x1f"
# Characters whose class is the same in every edition of Unicode.
PLAIN = re.compile("[\n\x20-\x7e\xa1-\u017f]*")
# The pattern of byte-level files, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Stretches of one text that are looked up at once.
PART = 500_000
# Texts on which a file is tried before it is used.
TRIAL = [
    "It's  a trial, we'll\n\n\tsee: 12,345 words (or none).  ",
    " x y می‌روم 中文 naïve \U0001f600!!\r\n a1b2 don't DON'T",
    "Plain text, of two lines,\nand a third.\n\nEnd ªº²½",
]


def _ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Ids by the bytes of their token; files write bytes that do not print as letters from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in prints]
    byte = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}
    return {bytes(byte[c] for c in token): i for token, i in vocabulary.items()}


class ByteTokenizer:
    """Ids of texts by a byte-level BPE file whose ids follow the order of its merges."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        content = json.loads(self.tokenizer.to_str())
        self.apart = [*OTHER_BLANKS, *[t["content"] for t in content["added_tokens"]]]
        ranks = _ranks(content["model"]["vocab"])
        self.words = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        # By what stands between two blanks; a word that begins a line has its line end, any other a blank before it.
        self.known: dict[str, bytes] = {}
        # Words between two blanks that other blanks border or split, and the empty one between two spaces.
        self.odd = {""}
        for text, ids in zip(TRIAL, self(TRIAL), strict=True):
            if ids != self._whole(text):
                raise ValueError(f"{path} is no byte-level BPE file of the expected pattern and order")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, text: str) -> bytes:
        if PLAIN.fullmatch(text):
            return array("I", self.words.encode_ordinary(text)).tobytes()
        return self._whole(text)

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words not known yet."""
        new = {}
        for word in words:
            text = word if word[:1] == "\n" else " " + word
            if PLAIN.fullmatch(word):
                new[word] = array("I", self.words.encode_ordinary(text)).tobytes()
            else:
                new[word] = self._whole(text)
                if BLANKS.search(word):
                    self.odd.add(word)
        if len(self.known) < CACHE:
            self.known.update(new)
        return new

    def _join(self, words: list[str], new: dict[str, bytes]) -> bytes:
        known = self.known
        if len(known) < CACHE:
            return b"".join(map(known.__getitem__, words))
        return b"".join([known[w] if w in known else new[w] for w in words])

    def _by_stretch(self, text: str) -> Iterator[bytes]:
        """Ids of a text of any blanks, part by part."""
        found = STRETCH.finditer(text)
        while part := [m.group() for m in islice(found, PART)]:
            words = {s[1:] for s in part if s[0] == " " and s[1:].strip()}
            new = self._learn(words.difference(self.known))
            ids = {w: self.known[w] if w in self.known else new[w] for w in words}
            others = {s: self._ids(s) for s in set(part) if s[0] != " " or s[1:] not in ids}
            yield b"".join([others[s] if s in others else ids[s[1:]] for s in part])

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = [b""] * len(texts)
        plain: dict[int, list[str]] = {}
        for i, text in enumerate(texts):
            if any(s in text for s in self.apart):
                out[i] = self._whole(text)
            elif len(text) > 4 * PART or "\n " in text or "\n\n\n" in text or text.endswith("\n\n"):
                out[i] = b"".join(self._by_stretch(text))
            else:
                plain[i] = text.replace("\n", " \n").split(" ")
        new = self._learn(set().union(*[words[1:] for words in plain.values()]).difference(self.known))
        for i, words in plain.items():
            first, rest = words[0], words[1:]
            if self.odd.isdisjoint(rest):
                out[i] = (self._ids(first) if first else b"") + self._join(rest, new)
            else:
                out[i] = b"".join(self._by_stretch(texts[i]))
        return out


_open: dict[str, ByteTokenizer] = {}


def tokenizer(path: str) -> ByteTokenizer:
    """The worker's tokenizer for a file, opened and tried once."""
    if path not in _open:
        _open[path] = ByteTokenizer(path)
    return _open[path]
