"""Encoding by the ``tokenizers`` library, each distinct piece of text once.

The library's time for a text goes mostly into the pieces, and most pieces recur. So texts
are split here by the pattern of byte-level BPE, and the library encodes the new pieces.
The ids are those that it gives for the whole text (tested).
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from millrace.llm.piece_cache import PieceCache


@lru_cache(maxsize=2)
def library_cache(path: str, special: bool = True) -> PieceCache:
    """The cache of this Python worker for the byte-level BPE file at ``path``.

    Without ``special``, special tokens that stand in a text are ordinary text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    split, added = told["pre_tokenizer"] or {}, told["added_tokens"]
    if split.get("type") != "ByteLevel" or split["add_prefix_space"] or told["normalizer"]:
        raise ValueError(f"not a plain byte-level BPE: {path}")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
        raise ValueError(f"special tokens with conditions are not supported: {path}")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [e.ids for e in library.encode_batch_fast(pieces, add_special_tokens=False)]
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.fromiter((t for r in rows for t in r), np.int32, int(counts.sum()))
        return ids, counts

    return PieceCache(encode, {t["content"]: t["id"] for t in added} if special else {})
