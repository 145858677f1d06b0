"""Texts of an Arrow batch as flat numpy arrays: bytes, words, hashes.

Every helper works on a slice of a batch that holds at most so many bytes (a single
longer text makes a slice of its own), so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_WORD = np.ones(256, bool)
IS_WORD[list(SEPARATORS)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with at most ``most`` bytes in ``column``, or one row each."""
    lengths = pc.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(lengths, dtype=np.int64), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins (one more for the end); null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[starts[0] : starts[-1]], starts - starts[0]


def mixed(values: np.ndarray) -> np.ndarray:
    """Each 64-bit value spread over all bits (one to one)."""
    x = values.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _coefficients(bits: int) -> np.ndarray:
    return mixed(np.arange(1, (1 << bits) + 1, dtype=np.uint64)) | np.uint64(1)


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span ``symbols[start:end]``, of its content and length alone.

    Spans don't overlap. Each place in a span has a coefficient of its own that follows from
    no other, so unlike in a polynomial no pattern of symbols cancels out at every base.
    """
    sizes = ends - starts
    most = int(sizes.max()) if len(sizes) else 0
    stop = np.cumsum(sizes)
    begin = stop - sizes
    n = int(stop[-1]) if len(stop) else 0
    at = np.arange(n)
    # Spans that leave nothing out need no copy of what is in them.
    inside = symbols if n == len(symbols) else symbols[at + np.repeat(starts - begin, sizes)]
    value = inside.astype(np.uint64) + np.uint64(1)
    value *= _coefficients(max(12, most.bit_length()))[at - np.repeat(begin, sizes)]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    return mixed(total[stop] - total[begin] + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` values in a row, by doubling; they may overlap."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, width = None, 0, words, 1
    while True:
        if size & width:
            here = power[done : done + n]
            out = here if out is None else mixed(out * np.uint64(0xD6E8FEB86659FD93) + here)
            done += width
        if 2 * width > size:
            return mixed(out + np.uint64(size))
        power = mixed(power[:-width] * np.uint64(0xA0761D6478BD642F) + power[width:])
        width *= 2


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts.

    ``starts``, ``ends``: bytes of each word in ``data``; ``first``: the index of each
    text's first word, and one more for the end; ``text``: the text of each word.
    """

    def __init__(self, column: pa.Array, lower: bool = False, cut: np.ndarray | None = None):
        """``cut``: for each byte and one more, whether words end and begin there as well."""
        self.data, self.offsets = utf8(column)
        if lower:
            self.data = LOWER[self.data]
        word, n = IS_WORD[self.data], len(self.data)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        if cut is not None:
            edge |= cut
        before = np.concatenate(([False], word))[:n]
        self.starts = np.flatnonzero(word & (edge[:n] | ~before))
        after = np.concatenate((word[1:], [False]))[:n]
        self.ends = np.flatnonzero(word & (edge[1:] | ~after)) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values[first[k]:first[k + 1]]`` for each k; 0 where there are none."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of each range, one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)
