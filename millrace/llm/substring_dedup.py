"""Substrings that recur anywhere in a corpus, by levels of doubled length.

A window of words can only recur if each shorter one in it does. So windows of a quarter of
the length asked for are counted first; those that recur are extended to twice that length
and counted again, and so on up to the length itself, until no candidates survive.

Below the full length a level needs one short window in each window asked for, as long as
all of its copies choose the same: the one with the smallest hash (the first of them). So it
counts about two in as many as a window has places for it, with the range of windows that
chose it. What recurs leaves ranges of candidates, and only their texts are read again.

Equal texts are one, with a count: of a text that is there twice every window recurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import Words, mixed, ranges, sequence_hashes, slices
from millrace.llm.hot_keys import hot_join
from millrace.llm.shared import written

WORDS = 35

_SEED = np.uint64(0x9E3779B97F4A7C15)
FOUND = "array<struct<h:bigint,first:int,last:int>>"


def levels(size: int) -> list[int]:
    """Lengths that are counted: each at most twice the one before, the last is ``size``."""
    quarter = -(-size // 4)
    return [n for n in (quarter, 2 * quarter) if n < size] + [size]


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Of each ``width`` values in a row, the place of the smallest, the first of equal ones."""
    place, done = np.arange(len(values)), 1
    while done < width:
        step = min(done, width - done)
        left, right = place[:-step], place[step:]
        place = np.where(values[left] <= values[right], left, right)
        done += step
    return place


def _windows(first: np.ndarray, size: int) -> np.ndarray:
    """For each word, whether a window of ``size`` words begins there and ends in its text."""
    n = int(first[-1])
    here = np.zeros(n, bool)
    here[ranges(first[:-1], np.maximum(0, np.diff(first) - size + 1))] = True
    return here


def anchors(
    h: np.ndarray, first: np.ndarray, size: int, level: int, wanted: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The short windows chosen by the windows of ``size`` words: hash, text, first and last.

    ``h``: hashes of the words of some texts, which begin at ``first``. ``first`` and
    ``last`` of the result: the words of the text at which the windows that chose it begin.
    ``wanted``: for each word, whether the window that begins there is looked at.
    """
    none = np.zeros(0, np.int64)
    here = _windows(first, size)
    if wanted is not None:
        here &= wanted
    start = np.flatnonzero(here)
    if not len(start):
        return none.astype(np.uint64), none, none, none
    short = sequence_hashes(h, level)
    place = start if level == size else _least_places(short, size - level + 1)[start]
    head = np.ones(len(start), bool)
    head[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(head)
    last = start[np.append(at[1:], len(start)) - 1]
    begin = start[at]
    text = np.searchsorted(first, begin, side="right") - 1
    return short[place[at]], text, begin - first[text], last - first[text]


def _covered(first: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which words lie from ``low`` to before ``high`` of their text, for one of these spans."""
    n = int(first[-1])
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first[text] + low, 1)
    np.add.at(change, first[text] + high, -1)
    return np.cumsum(change)[:n] > 0


def _spans(column: pa.Array, first: np.ndarray, reach: int) -> np.ndarray:
    """Words from each span's first to ``reach`` beyond its last, of lists of spans."""
    counts = np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    low, high = (flat.field(c).to_numpy().astype(np.int64) for c in ("first", "last"))
    return _covered(first, np.repeat(np.arange(len(counts)), counts), low, high + reach)


def kept_text(words: Words, gone: np.ndarray) -> list[bytes]:
    """Of each text, the words that are not ``gone``, joined by one space."""
    stay = np.flatnonzero(~gone)
    sizes = words.ends[stay] - words.starts[stay] + 1
    # Each word with the separator after it; a text ends without one, so there it is made.
    flat = np.append(words.data, np.uint8(0x20))[ranges(words.starts[stay], sizes)]
    stop = np.cumsum(sizes)
    flat[stop - 1] = 0x20
    raw = flat.tobytes()
    bounds = np.searchsorted(stay, words.first)
    ends = np.concatenate(([0], stop))
    return [
        raw[a : max(a, b - 1)] for a, b in zip(ends[bounds[:-1]].tolist(), ends[bounds[1:]].tolist(), strict=True)
    ]


def _as_text(kept: list[bytes]) -> pa.Array:
    return pa.array(kept, pa.binary()).cast(pa.string())


def _as_digest(kept: list[bytes]) -> pa.Array:
    return pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())


def _described(batches, size: int, finish: Callable) -> Iterator[pa.RecordBatch]:
    """Each text's count of words, what it is if nothing is removed, and its anchors."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part["text"])
            h, text, low, high = anchors(words.hashes(), words.first, size, levels(size)[0])
            bounds = np.searchsorted(text, np.arange(part.num_rows + 1))
            found = pa.StructArray.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(low, pa.int32()), pa.array(high, pa.int32())],
                ["h", "first", "last"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    *(part[c] for c in ("uid", "doc_id", "k1", "k2")),
                    pa.array(words.counts.astype(np.int64)),
                    finish(kept_text(words, np.zeros(len(words.starts), bool))),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), found),
                ],
                ["uid", "doc_id", "k1", "k2", "n_words", "kept", "found"],
            )


def _extended(batches, size: int, level: int) -> Iterator[pa.RecordBatch]:
    """The windows of ``level`` words chosen by candidates: hashes, text, and candidates."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part["text"])
            wanted = _spans(part["ranges"], words.first, 1)
            own = words.hashes()
            h, text, low, high = anchors(own, words.first, size, level, wanted)
            # The full length is told apart by 128 bits, as there many are compared.
            more = np.zeros(len(h), np.int64)
            if level == size and len(h):
                more = sequence_hashes(mixed(own ^ _SEED), size)[words.first[text] + low].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h.view(np.int64)),
                    pa.array(more),
                    part["uid"].take(pa.array(text)),
                    pa.array(low, pa.int32()),
                    pa.array(high, pa.int32()),
                ],
                ["h", "g", "uid", "first", "last"],
            )


def _removed(batches, size: int, finish: Callable) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part["text"])
            gone = _spans(part["ranges"], words.first, size)
            change = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
            inner = words.first[1:-1]
            cut = inner[(inner > 0) & (inner < len(gone))]
            low, high = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
            split = cut[gone[cut - 1] & gone[cut]]  # texts that meet within a run
            low, high = np.union1d(low, split), np.union1d(high, split)
            text = np.searchsorted(words.first, low, side="right") - 1
            bounds = np.searchsorted(text, np.arange(part.num_rows + 1))
            runs = pa.StructArray.from_arrays(
                [pa.array(low - words.first[text], pa.int32()), pa.array(high - words.first[text], pa.int32())],
                ["start", "end"],
            )
            total = np.concatenate(([0], np.cumsum(gone)))
            yield pa.RecordBatch.from_arrays(
                [
                    part["uid"],
                    pa.array(total[words.first[1:]] - total[words.first[:-1]], pa.int64()),
                    finish(kept_text(words, gone)),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs),
                ],
                ["uid", "n_removed", "kept", "removed"],
            )


def _recurring(rows: DataFrame, keys: list[str], name: str) -> DataFrame | None:
    """``uid, ranges`` of the windows whose ``keys`` are on more than one row; None if none.

    Counts are combined in each task before they are shuffled; a hot window's rows are dealt
    to several tasks.
    """
    counts = written(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), name)
    if counts.isEmpty():
        return None
    spans = hot_join(rows, counts.select(*keys), counts, keys, "uid", "left_semi")
    return spans.groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = WORDS,
    digest: bool = False,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, removed`` of each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, as they are. A window is ``size``
    words in a row of one text. Every word in a window whose words also start anywhere else,
    in the same or another row, is removed: all of its occurrences go, and windows are judged
    by the texts as they came. ``kept`` is what stays, joined by one space (or, with
    ``digest``, its SHA-256 in hex), ``removed`` the runs of words (from 0, end exclusive)
    that go.

    A null or empty text, or one of fewer words than ``size``, has no window and keeps its
    words. Repeated rows are different rows, so their windows recur; rows of a null id take
    part as all others do. Other columns are not read, no rows give none.

    Windows are told apart by 128 bits of hash. Memory of a task follows the longest text.
    """
    if size < 1:
        raise ValueError("a window has at least one word")
    finish, lengths = (_as_digest if digest else _as_text), levels(size)
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumns(
        {"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")}
    )
    kind = narrow.schema["doc_id"].dataType.simpleString()
    described = written(
        narrow.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(
            lambda b: _described(b, size, finish),
            f"uid bigint, doc_id {kind}, k1 bigint, k2 bigint, n_words bigint, kept string, found {FOUND}",
        ),
        "described",
    )
    classes = written(
        described.where(F.col("n_words") >= size)
        .groupBy("k1", "k2")
        .agg(F.min("uid").alias("uid"), F.count("*").alias("n")),
        "texts",
    )
    rows = described.select("uid", F.explode("found").alias("x")).select("uid", "x.*")
    recurring = _recurring(rows, ["h"], "level")
    changed = None
    if recurring is not None:
        texts = narrow.select("k1", "k2", "text").dropDuplicates(["k1", "k2"])
        candidates = written(
            texts.join(classes.join(recurring, "uid"), ["k1", "k2"]).select("uid", "n", "text", "ranges"),
            "candidates",
        )
        for level in lengths[1:]:
            found = candidates.mapInArrow(
                lambda b, level=level: _extended(b, size, level),
                "h bigint, g bigint, uid bigint, first int, last int",
            )
            recurring = _recurring(found, ["h", "g"], "level")
            if recurring is None:
                break
            candidates = candidates.drop("ranges").join(recurring, "uid")
            if level < size:
                candidates = written(candidates, "candidates")
        else:
            changed = candidates.where("n = 1").mapInArrow(
                lambda b: _removed(b, size, finish),
                "uid bigint, n_removed bigint, kept string, removed array<struct<start:int,end:int>>",
            )
    plain = described.select("uid", "doc_id", "k1", "k2", "n_words", "kept")
    several = classes.where("n > 1")
    twice = several.select("k1", "k2", F.lit(True).alias("twice"))
    told = hot_join(plain, twice, several, ["k1", "k2"], "uid", "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    if changed is None:
        changed = plain.where("false").select(
            "uid", F.lit(0).cast("bigint").alias("n_removed"), "kept", none.alias("removed")
        )
    changed = changed.withColumnsRenamed({"kept": "left", "n_removed": "some"})
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    empty = F.sha2(F.lit(""), 256) if digest else F.lit("")
    twice = F.col("twice").isNotNull()
    return told.join(changed, "uid", "left").select(
        "doc_id",
        "n_words",
        F.when(twice, F.col("n_words")).otherwise(F.coalesce("some", F.lit(0))).alias("n_removed"),
        F.when(twice, empty).otherwise(F.coalesce("left", "kept")).alias("kept"),
        F.when(twice, whole).otherwise(F.coalesce("removed", none)).alias("removed"),
    )


SUBSTRING_DEDUP_SQL = r"""
    WITH texts AS (
        SELECT row_number() OVER () AS r, doc_id,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), starts AS (
        SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM texts
    ), windows AS (
        SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM starts
    ), again AS (
        SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1
    ), gone AS (
        SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM again
    ), words AS (
        SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM texts
    ), kept AS (
        SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS s
        FROM words ANTI JOIN gone USING (r, k) GROUP BY r
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
           CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
           sha256(coalesce(s, '')) AS kept_sha256
    FROM texts LEFT JOIN kept USING (r)
"""
