"""Byte-level BPE encoding and decoding by speculation and check.

For each distinct piece of text a greedy longest match proposes tokens. A row of tokens is
what the merges would give if and only if each token is made from its own bytes and each
two neighbours are: so the neighbours of all proposals are checked together, in numpy, and
only pieces with a bad pair are merged step by step.

The check of a pair (a, b) goes back in time. At each moment one token of a's right edge
touches one of b's left edge; if the vocabulary merges these two sooner than either goes
into its own parent, the merges would have crossed the boundary. (Of two merges of one
rank the left one is first.)
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import ranges, slices
from millrace.llm.piece_cache import PieceCache

NEVER = np.iinfo(np.int64).max


def _byte_letters() -> dict[str, int]:
    """The letters in which vocabulary files of this kind write bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class BytePairs:
    """The vocabulary in a ``tokenizers`` file: byte-level BPE with added special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        kind = told["model"]["type"], (told["pre_tokenizer"] or {}).get("type"), told["normalizer"]
        if kind != ("BPE", "ByteLevel", None) or told["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"not a plain byte-level BPE: {path}")
        letters = _byte_letters()
        in_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = told["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.text = [b""] * size
        for s, k in vocab.items():
            self.text[k] = in_bytes(s)
        for s, k in self.special.items():
            self.text[k] = s.encode()
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(told["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            whole = vocab[a + b]
            self.merges[vocab[a], vocab[b]] = rank, whole
            if self.rank[whole] < 0:  # else it is made by an earlier merge already
                self.rank[whole], self.left[whole], self.right[whole] = rank, vocab[a], vocab[b]
        self.byte = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        keys = np.array([(a << 32) | b for a, b in self.merges], np.int64)
        ranks = np.array([r for r, _ in self.merges.values()], np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], ranks[order]
        sound = self._sound()
        self.by_text = {t: k for k, t in enumerate(self.text) if k in sound}
        self.longest = {}
        for t in self.by_text:
            self.longest[t[:2]] = max(self.longest.get(t[:2], 1), len(t))
        lengths = np.array([len(t) for t in self.text], np.int64)
        self._bytes = np.frombuffer(b"".join(self.text), np.uint8)
        self._lengths, self._starts = lengths, np.cumsum(lengths) - lengths

    def _sound(self) -> set[int]:
        """The tokens that their own bytes are merged into."""
        made = np.flatnonzero(self.rank >= 0)
        rank = self.rank[made]
        fits = dict(
            zip(
                made.tolist(),
                self.compatible(self.left[made], self.right[made], rank, rank).tolist(),
                strict=True,
            )
        )
        sound = set(self.byte)
        for k in made[np.argsort(rank)].tolist():
            if fits[k] and int(self.left[k]) in sound and int(self.right[k]) in sound:
                sound.add(k)
        return sound

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], NEVER)

    def compatible(self, a, b, a_until=None, b_until=None) -> np.ndarray:
        """Whether no merge crosses from token ``a[k]`` to ``b[k]``, for each k.

        ``until``: the rank at which the token goes into its parent; never, unless given.
        """
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
        a_until = np.full(len(a), NEVER) if a_until is None else a_until.copy()
        b_until = np.full(len(b), NEVER) if b_until is None else b_until.copy()
        while len(live):
            rank = self._merge_rank(a, b)
            crossed = (rank < a_until) & (rank <= b_until) & (rank != NEVER)
            good[live[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossed & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            a_until, b_until = a_until[go], b_until[go]
            back = ra > rb
            a_until, b_until = np.where(back, ra, a_until), np.where(back, b_until, rb)
            a, b = np.where(back, self.right[a], a), np.where(back, b, self.left[b])
        return good

    def greedy(self, piece: bytes) -> list[int]:
        """The longest token at each place, one after the other."""
        out, at, n, known, longest = [], 0, len(piece), self.by_text, self.longest
        while at < n:
            stop = min(n, at + longest.get(piece[at : at + 2], 1))
            while (token := known.get(piece[at:stop])) is None:
                stop -= 1
            out.append(token)
            at = stop
        return out

    def merged(self, piece: bytes) -> list[int]:
        """The tokens of ``piece`` by its merges, lowest rank first, then leftmost."""
        ids = [self.byte[b] for b in piece]
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for k in range(n - 1):
            if (m := merges.get((ids[k], ids[k + 1]))) is not None:
                heap.append((m[0], k, ids[k], ids[k + 1]))
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] != a or nxt >= n or ids[nxt] != b:
                continue
            ids[k], ids[nxt] = merges[a, b][1], -1
            after[k] = after[nxt]
            if after[k] < n:
                before[after[k]] = k
                if (m := merges.get((ids[k], ids[after[k]]))) is not None:
                    heapq.heappush(heap, (m[0], k, ids[k], ids[after[k]]))
            if before[k] >= 0 and (m := merges.get((ids[before[k]], ids[k]))) is not None:
                heapq.heappush(heap, (m[0], before[k], ids[before[k]], ids[k]))
        return [t for t in ids if t >= 0]

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, flat, and the number of each piece's."""
        raw = [p.encode() for p in pieces]
        rows = [self.greedy(p) for p in raw]
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.fromiter((t for r in rows for t in r), np.int64, int(counts.sum()))
        row = np.repeat(np.arange(len(rows)), counts)
        inside = np.flatnonzero(row[1:] == row[:-1])
        failing = np.unique(row[inside[~self.compatible(ids[inside], ids[inside + 1])]])
        if len(failing):
            for k in failing.tolist():
                rows[k] = self.merged(raw[k])
            counts = np.fromiter(map(len, rows), np.int64, len(rows))
            ids = np.fromiter((t for r in rows for t in r), np.int64, int(counts.sum()))
        return ids.astype(np.int32), counts

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ``ids`` stand for, specials included."""
        return self._bytes[ranges(self._starts[ids], self._lengths[ids])].tobytes()


@lru_cache(maxsize=2)
def byte_pairs(path: str) -> tuple[BytePairs, PieceCache]:
    """The vocabulary at ``path`` and the cache of this Python worker."""
    pairs = BytePairs(path)
    return pairs, PieceCache(pairs.pieces, pairs.special)


def _encoded(batches, path: str, id_col: str, text_col: str) -> Iterator[pa.RecordBatch]:
    _, cache = byte_pairs(path)
    for batch in batches:
        for part in slices(batch, text_col):
            texts = part[text_col].fill_null("").to_pylist()
            ids, counts = cache.texts(texts)
            offsets = np.concatenate(([0], np.cumsum(counts)))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part[id_col], lists], ["doc_id", "ids"])


def bpe_encode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, ids array<int>`` for each row of ``docs``: the ids of its whole text.

    As the ``tokenizers`` library encodes with the vocabulary file at ``path`` without
    adding special tokens; those that stand in a text get their ids. A null or empty text
    has no ids. Repeated rows give repeated rows; other columns are not read; no rows give
    no rows. Needs no shuffle. Memory follows the longest text.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(
        lambda batches: _encoded(batches, path, "doc_id", "text"),
        f"doc_id {kind}, ids array<int>",
    )


def bpe_decode(
    encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """``doc_id, text`` for each row: what ``ids`` stand for, special tokens included.

    Bytes that are not UTF-8 become U+FFFD. Null ids give an empty text, an id that the
    vocabulary lacks fails.
    """
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        pairs, _ = byte_pairs(path)
        for batch in batches:
            texts = [
                pairs.decode(np.asarray(r or [], np.int64)).decode("utf-8", "replace")
                for r in batch["ids"].to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts)], ["doc_id", "text"])

    narrow = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return narrow.mapInArrow(run, f"doc_id {kind}, text string")


def bpe_digests(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row of ``docs``.

    The ids are those of ``bpe_encode`` and the text that of ``bpe_decode``, both made in
    one pass, as the ids of a large corpus need not leave the task for a digest of them.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches):
        pairs, cache = byte_pairs(path)
        number = [str(k) for k in range(len(pairs.text))]
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = cache.texts(part["text"].fill_null("").to_pylist())
                ends = np.cumsum(counts)
                decoded = pairs.decode(ids)
                size = np.concatenate(([0], np.cumsum(pairs._lengths[ids])))
                digests = [], []
                for stop, count in zip(ends.tolist(), counts.tolist(), strict=True):
                    begin = stop - count
                    told = ",".join(map(number.__getitem__, ids[begin:stop].tolist()))
                    digests[0].append(hashlib.sha256(told.encode()).hexdigest())
                    text = decoded[size[begin] : size[stop]].decode("utf-8", "replace")
                    digests[1].append(hashlib.sha256(text.encode()).hexdigest())
                columns = [part["doc_id"], pa.array(counts), *map(pa.array, digests)]
                columns[2:] = [c.cast(pa.string()) for c in columns[2:]]
                yield pa.RecordBatch.from_arrays(
                    columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                )

    return narrow.mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
