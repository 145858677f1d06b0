"""The split of byte-level BPE before its merges, for all texts of a slice at once.

The pattern is 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
Runs of one class of characters (letter, number, white space, other) are pieces, save that
a space before another run belongs to it, other white space before a run stands alone, and
a lone apostrophe takes the letters of an English ending.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import regex
from tokenizers.pre_tokenizers import ByteLevel

from millrace.llm.arrays import span_hashes

LETTER, NUMBER, SPACE, OTHER = range(4)
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")  # fixed values of the pattern


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
    text = points.tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            table[points[m.start() : m.end()]] = kind
    # The newest characters are in some Unicode tables and not in others. The library's own
    # count: beside a letter or number, one of the same class makes one piece with it.
    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for c in np.flatnonzero(table != OTHER).tolist():
        if unicodedata.category(chr(c)) == "Cn":
            sample = {LETTER: "a", NUMBER: "1", OTHER: "!"}
            table[c] = next((k for k, x in sample.items() if len(split(x + chr(c))) == 1), SPACE)
    return table


class Pretokens:
    """Pieces of ``texts``: ``starts``/``ends`` in ``joined``, ``first`` piece of each text."""

    def __init__(self, texts: list[str]):
        self.joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        self.points = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        n, x = len(self.points), self.points
        start = np.zeros(n + 1, bool)
        if n:
            kind = classes()[x]
            edge = np.zeros(n + 1, bool)
            edge[self.offsets] = True
            first = np.empty(n, bool)  # of a run
            first[0] = True
            np.not_equal(kind[1:], kind[:-1], out=first[1:])
            first |= edge[:n]
            start[:n] = first
            heads = np.flatnonzero(first & (kind != SPACE) & ~edge[:n])
            heads = heads[kind[heads - 1] == SPACE]
            start[heads - 1] = True  # the last of the white space parts from the rest of it
            start[heads[x[heads - 1] == 0x20]] = False
            self._endings(x, kind, first, edge, start)
        self.starts = np.flatnonzero(start[:n])
        self.ends = np.append(self.starts[1:], n) if len(self.starts) else self.starts
        self.first = np.searchsorted(self.starts, self.offsets)

    @staticmethod
    def _endings(x, kind, first, edge, start):
        n = len(x)
        p = np.flatnonzero((x[:-1] == 0x27) & first[:-1] & (kind[1:] == LETTER) & ~edge[1:n])
        p = p[edge[p] | (x[p - 1] != 0x20)]
        for ending in ENDINGS:
            at = p[p + len(ending) < n]
            for k, c in enumerate(ending, 1):
                at = at[(x[at + k] == ord(c)) & ~edge[at + k]]
            start[at + 1] = False
            start[at + len(ending) + 1] = True
        # A piece never reaches past its text: edges are runs' starts already.

    def hashes(self) -> np.ndarray:
        return span_hashes(self.points, self.starts, self.ends)

    def piece(self, k: int) -> str:
        return self.joined[self.starts[k] : self.ends[k]]
