"""Quality rules: counts of a text, and repetition by a suffix array over its words.

All texts of a slice share one suffix array; a suffix starts with the number of its text,
so suffixes of two texts are never alike. Ranks are refined by prefix doubling, each round
only where suffixes still tie, and every round's ranks are kept: the longest common prefix
of neighbours follows from them without a pass over the words.

An interval of neighbours with a common prefix of v words stands for a repeated substring
of v words at each suffix of it. The longest interval that a suffix lies in has the larger
of its two common prefixes with its neighbours. So the union of the spans of all maximal
repeats of at least ``min_words`` words is the union of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import IS_WORD, Words, mixed, slices, span_hashes, sums

SYMBOLS = b"#*$%&|<>"
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True

MIN_WORDS = 10
MOST_COVERED = 0.2
LONGEST = 100


def _refined(rank: np.ndarray, at: np.ndarray, step: int, owner: np.ndarray) -> np.ndarray:
    """``rank`` after ties among the suffixes ``at`` are told apart by what is ``step`` on."""
    nxt = np.minimum(at + step, len(rank) - 1)
    inside = (at + step < len(rank)) & (owner[nxt] == owner[at])
    second = np.where(inside, rank[nxt] + 1, 0)
    key = (rank[at].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    group = rank[at[order]]
    # Ranks are places in the suffix array: a group's place, and the number before it there.
    of_group = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    base = np.repeat(of_group, np.diff(np.append(of_group, len(group))))
    place = group + (np.repeat(head, np.diff(np.append(head, len(key)))) - base)
    out = rank.copy()
    out[at[order]] = place
    return out


def repeats(symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each position, the longest run from it that starts elsewhere in its text, too."""
    n = len(symbols)
    if n < 2:
        return np.zeros(n, np.int64)
    key = (owner.astype(np.uint64) << np.uint64(32)) | symbols.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    levels, step = [rank.astype(np.int32)], 1
    while True:
        size = np.bincount(rank, minlength=n)
        tied = np.flatnonzero(size[rank] > 1)
        if not len(tied):
            break
        rank = _refined(rank, tied, step, owner)
        levels.append(rank.astype(np.int32))
        step *= 2
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    a, b = suffix[:-1], suffix[1:]
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        # Equal ranks of level k: the next 2**k words are alike (or both texts end, alike).
        i, j = a + common, b + common
        live = np.flatnonzero((j < n) & (i < n))
        live = live[(owner[i[live]] == owner[a[live]]) & (owner[j[live]] == owner[a[live]])]
        same = levels[k][i[live]] == levels[k][j[live]]
        common[live[same]] += 1 << k
    out = np.zeros(n, np.int64)
    out[suffix[1:]] = common
    out[suffix[:-1]] = np.maximum(out[suffix[:-1]], common)
    return out


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in one of the spans."""
    change = np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int64)
    change -= np.bincount(starts + lengths, minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] > 0


def _of_text(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    return mixed(values + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _dup_lines(words: Words) -> np.ndarray:
    data, n = words.data, len(words.data)
    newline = np.flatnonzero(data == 0x0A)
    starts = np.union1d(words.offsets[:-1][np.diff(words.offsets) > 0], newline + 1)
    starts = starts[starts < n]
    text = np.searchsorted(words.offsets, starts, side="right") - 1
    ends = np.append(newline, n)[np.searchsorted(newline, starts)]
    ends = np.minimum(ends, words.offsets[text + 1])
    filled = np.concatenate(([0], np.cumsum(IS_WORD[data])))
    kept = filled[ends] > filled[starts]
    starts, ends, text = starts[kept], ends[kept], text[kept]
    again = pd.Series(_of_text(span_hashes(data, starts, ends), text)).duplicated().to_numpy()
    return np.bincount(text[again], minlength=len(words.counts))


def _repeat_words(words: Words, h: np.ndarray) -> np.ndarray:
    n = len(h)
    if n < 3:
        return np.zeros(len(words.counts), np.int64)
    at = np.flatnonzero(words.text[2:] == words.text[:-2])
    window = h[at] * np.uint64(0xD6E8FEB86659FD93) + mixed(h[at + 1]) + (h[at + 2] << np.uint64(1))
    window ^= h[at + 2] >> np.uint64(63)
    twice = pd.Series(_of_text(mixed(window), words.text[at])).duplicated(keep=False).to_numpy()
    inside = _covered(at[twice], np.full(int(twice.sum()), 3), n)
    return sums(inside, words.first)


def measures(
    column: pa.Array,
    min_words: int = MIN_WORDS,
    most_covered: float = MOST_COVERED,
    longest: int = LONGEST,
) -> dict[str, np.ndarray]:
    """Counts and verdicts of each text of ``column``; see ``quality_rules``."""
    words = Words(column)
    out = {"n_words": words.counts}
    lead = IS_WORD[words.data] & ((words.data & 0xC0) != 0x80)
    out["word_chars"] = sums(lead, words.offsets)
    out["n_symbols"] = sums(IS_SYMBOL[words.data], words.offsets)
    out["n_dup_lines"] = _dup_lines(words)
    h = words.hashes()
    out["n_repeat_words"] = _repeat_words(words, h)
    length = repeats(pd.factorize(h)[0], words.text)
    long = np.flatnonzero(length >= min_words)
    out["covered_words"] = sums(_covered(long, length[long], len(h)), words.first)
    most = np.zeros(len(words.counts), np.int64)
    np.maximum.at(most, words.text, length)
    out["longest_repeat"] = most
    out = {k: v.astype(np.int64) for k, v in out.items()}
    n = out["n_words"]
    out["base_failed"] = (n < 50) | (100 * out["n_repeat_words"] > 50 * n)
    fine = (out["covered_words"] <= most_covered * n) & (most <= longest)
    out["kept"] = ~out["base_failed"] & fine
    return out


COUNTS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words covered_words longest_repeat".split()
)
VERDICTS = ["base_failed", "kept"]


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    most_covered: float = MOST_COVERED,
    longest: int = LONGEST,
) -> DataFrame:
    """``doc_id``, counts (``bigint``) and verdicts (``boolean``) of each row's whole text.

    Words are ``[^\\x20\\x09-\\x0D]+``; ``word_chars`` are code points in them, ``n_symbols``
    the characters ``#*$%&|<>``, ``n_dup_lines`` the lines that have a word and equal an
    earlier line of the text, ``n_repeat_words`` the words in three-word windows found twice
    or more. ``covered_words`` are the words in repeated substrings of at least
    ``min_words`` words, ``longest_repeat`` the words of the longest one of any length
    (the occurrences may overlap).

    ``base_failed``: fewer than 50 words, or more than half of them in repeated three-word
    windows. ``kept``: not ``base_failed``, at most ``most_covered`` of the words in
    repeated substrings of ``min_words`` or more, and none of over ``longest`` words.

    A null, empty or blank text has zeros and fails. Repeated rows give repeated rows, no
    rows none. Other columns are not read, nothing is shuffled.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    names = [*COUNTS, *VERDICTS]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                got = measures(part["text"], min_words, most_covered, longest)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], *(pa.array(got[c]) for c in names)], ["doc_id", *names]
                )

    kinds = [f"{c} bigint" for c in COUNTS] + [f"{c} boolean" for c in VERDICTS]
    return narrow.mapInArrow(run, f"doc_id {kind}, " + ", ".join(kinds))


def passing(
    docs: DataFrame,
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    most_covered: float = MOST_COVERED,
    longest: int = LONGEST,
) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, all columns as they are.

    Null, empty and blank texts have too few words and go. Each copy of a repeated row is
    judged as it is; ids play no part, so rows of a null id are judged like others. No rows
    give none.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                got = measures(part[text_col], min_words, most_covered, longest)
                yield part.filter(pa.array(got["kept"]))

    return docs.mapInArrow(run, docs.schema)


#: Runs of equal words at one distance are what two suffixes of a text have in common.
QUALITY_SQL = r"""
    WITH texts AS (
        SELECT doc_id, coalesce(text, '') AS t FROM documents
    ), words AS (
        SELECT doc_id, unnest(w) AS s, unnest(range(len(w))) AS i
        FROM (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts)
    ), pairs AS (
        SELECT a.doc_id, a.i, b.i - a.i AS d,
               a.i - row_number() OVER (PARTITION BY a.doc_id, b.i - a.i ORDER BY a.i) AS run
        FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.s = b.s AND a.i < b.i
    ), runs AS (
        SELECT doc_id, d, min(i) AS i, count(*) AS n FROM pairs GROUP BY doc_id, d, run
    ), inside AS (
        SELECT doc_id, unnest(range(i, i + n)) AS k, n FROM runs WHERE n >= 3
        UNION ALL
        SELECT doc_id, unnest(range(i + d, i + d + n)), n FROM runs WHERE n >= 3
    ), repeated AS (
        SELECT doc_id, count(DISTINCT k) AS n_repeat_words,
               count(DISTINCT k) FILTER (n >= 10) AS covered_words
        FROM inside GROUP BY doc_id
    ), longest AS (
        SELECT doc_id, max(n) AS longest_repeat FROM runs GROUP BY doc_id
    ), lines AS (
        SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
        FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
    ), sizes AS (
        SELECT doc_id, count(*) AS n_words, CAST(sum(length(s)) AS BIGINT) AS word_chars
        FROM words GROUP BY doc_id
    ), counts AS (
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
               length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
               coalesce(n_dup_lines, 0) AS n_dup_lines,
               coalesce(n_repeat_words, 0) AS n_repeat_words,
               coalesce(covered_words, 0) AS covered_words,
               coalesce(longest_repeat, 0) AS longest_repeat
        FROM texts LEFT JOIN sizes USING (doc_id) LEFT JOIN lines USING (doc_id)
        LEFT JOIN repeated USING (doc_id) LEFT JOIN longest USING (doc_id)
    )
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
           AND 5 * covered_words <= n_words AND longest_repeat <= 100 AS kept
    FROM counts
"""
