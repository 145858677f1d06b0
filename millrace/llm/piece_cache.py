"""What was worked out for each distinct piece of text, kept by a Python worker.

A piece's ids depend on the piece alone, so they may be kept from one batch to the next.
The cache holds a bounded number of pieces and starts over beyond it; results do not
depend on what it holds. Pieces are looked up by a 64-bit hash and then compared, so two
pieces of one hash are told apart.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from millrace.llm.arrays import ranges
from millrace.llm.pretokens import Pretokens

MOST_PIECES = 1 << 20


class _Grown:
    """Values one after the other, in an array that doubles."""

    def __init__(self, kind: type):
        self.room, self.size = np.zeros(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> None:
        stop = self.size + len(values)
        if stop > len(self.room):
            self.room = np.resize(self.room, max(stop, 2 * len(self.room)))
        self.room[self.size : stop] = values
        self.size = stop


class PieceCache:
    """``encode(pieces)`` gives the ids of each piece of a list: flat ids, and counts.

    ``special``: tokens that stand for themselves wherever they are in a text.
    """

    def __init__(
        self,
        encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
        special: dict[str, int],
    ):
        self.encode, self.special = encode, special
        self._forget()

    def _forget(self):
        self.keys = np.zeros(0, np.uint64)
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.begins, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.points = _Grown(np.int32), _Grown(np.uint32)

    def _rows(self, keys: np.ndarray, pieces: Pretokens, example: np.ndarray) -> np.ndarray:
        """The row of each of the distinct ``keys``; ``example``: a piece of each."""
        if len(self.keys) > MOST_PIECES:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(
            self.keys[np.minimum(at, len(self.keys) - 1)] != keys if len(self.keys) else at == at
        )
        if len(new):
            ids, counts = self.encode([pieces.piece(k) for k in example[new].tolist()])
            sizes = pieces.ends[example[new]] - pieces.starts[example[new]]
            together = np.concatenate((self.keys, keys[new]))
            order = np.argsort(together, kind="stable")
            self.keys = together[order]
            for name, own, grown in (("starts", counts, self.ids), ("begins", sizes, self.points)):
                first = grown.size + np.cumsum(own) - own
                setattr(self, name, np.concatenate((getattr(self, name), first))[order])
            self.counts = np.concatenate((self.counts, counts))[order]
            self.sizes = np.concatenate((self.sizes, sizes))[order]
            self.ids.add(ids)
            self.points.add(pieces.points[ranges(pieces.starts[example[new]], sizes)])
            at = np.searchsorted(self.keys, keys)
        return at

    def _others(self, pieces: Pretokens, rows: np.ndarray) -> np.ndarray:
        """The pieces that are not what the cache has in their row."""
        sizes = pieces.ends - pieces.starts
        other = self.sizes[rows] != sizes
        if not other.any():  # as it all but always is: pieces are all of the texts, in order
            shift = np.repeat(self.begins[rows] - pieces.starts, sizes)
            shift += np.arange(len(shift))
            if np.array_equal(self.points.room[shift], pieces.points):
                return np.zeros(0, np.int64)
        alike = np.flatnonzero(~other)
        size = sizes[alike]
        known = self.points.room[ranges(self.begins[rows[alike]], size)]
        wrong = np.concatenate(([0], np.cumsum(known != pieces.points[ranges(pieces.starts[alike], size)])))
        stop = np.cumsum(size)
        other[alike] = wrong[stop] > wrong[stop - size]
        return np.flatnonzero(other)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts``, one after the other, and the number of each text's."""
        if not any(s in t for t in texts for s in self.special):
            return self._plain(texts)
        parts, owner = [], []
        for k, text in enumerate(texts):
            for part in self._split(text):
                parts.append(part)
                owner.append(k)
        ids, counts = self._plain([p if isinstance(p, str) else "" for p in parts])
        special = np.array([p if isinstance(p, int) else -1 for p in parts])
        ids = np.insert(ids, np.cumsum(counts)[special >= 0], special[special >= 0])
        counts = counts + (special >= 0)
        return ids, np.bincount(owner, counts, len(texts)).astype(np.int64)

    def _split(self, text: str) -> list[str | int]:
        """``text`` cut at its special tokens, leftmost first; these are given as ids."""
        out: list[str | int] = []
        at = 0
        while found := [(k, -len(s), s) for s in self.special if (k := text.find(s, at)) >= 0]:
            k, _, s = min(found)
            out += [text[at:k], self.special[s]]
            at = k + len(s)
        return [*out, text[at:]]

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = Pretokens(texts)
        code, keys = pd.factorize(pieces.hashes())
        example = np.zeros(len(keys), np.int64)
        example[code[::-1]] = np.arange(len(code))[::-1]
        rows = self._rows(keys, pieces, example)[code]
        starts, counts, ids = self.starts[rows], self.counts[rows], self.ids.room
        others = self._others(pieces, rows)
        if len(others):
            own, n = self.encode([pieces.piece(k) for k in others.tolist()])
            starts[others] = self.ids.size + np.cumsum(n) - n
            counts[others] = n
            ids = np.concatenate((ids[: self.ids.size], own.astype(np.int32)))
        ids = ids[ranges(starts, counts)]
        total = np.concatenate(([0], np.cumsum(counts)))
        return ids, total[pieces.first[1:]] - total[pieces.first[:-1]]
