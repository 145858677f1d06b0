"""Benchmark decontamination: CGK embedding, bit sampling, exact edit distance.

Words are the symbols. The CGK embedding of a window walks along it at random: at step t it
gives the word under its pointer and goes on to the next if the word's t-th random bit says
so. Two windows a few edits apart give embeddings a few positions (Hamming) apart, since
their walks fall in step again after an edit. A walk has two steps a word, so on average it
comes to the window's end, where it stays. Bit sampling hashes an embedding to what it has
at a few steps; several walks and samples give edits many chances. Insertions alone, or
deletions alone, drive two walks apart, so each walk is sampled on a stretch of its own, of
16 steps to all of them, that begins anywhere in the window.

Windows are sized by the items: an item of n words is looked for by windows of w words,
the largest power of two with w + w/2 - 1 <= n, taken from a text each w/4 words and from
an item at each word, cut where the text or item ends. How many walks a window size takes
follows from the edits allowed and a recall, by trials on items with as many edits as that.
A window that shares a hash places the item in the text; there the edit distance of the
whole item to its best place is computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import Words, mixed, ranges, sequence_hashes, slices, utf8

WALKS = 4
SAMPLES = 8  # hashes of each walk
STEPS = 4  # sampled for a hash
STEPS_A_WORD = 2  # of a walk
FIRST_STEPS = 16  # of the shortest stretch that samples are drawn from
DISTINCT = 3  # words that the sampled steps have to be on
RECALL = 0.995  # of items with as many edits as allowed
TRIALS = 400  # for each length
KINDS = 4  # of trials
MOST_WALKS = 64
PERCENT = 70
MIN_WORDS = 8
MIN_VERBATIM_WORDS = 4
BLOCK_BYTES = 1 << 20
VERIFY_CELLS = 4 << 20
WINDOWS_AT_ONCE = 1 << 13  # that walk together, so that a step's arrays stay in the cache

_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[ord("0") : ord("9") + 1] = range(ord("0"), ord("9") + 1)
_PLAIN[ord("a") : ord("z") + 1] = range(ord("a"), ord("z") + 1)
_PLAIN[ord("A") : ord("Z") + 1] = range(ord("a"), ord("z") + 1)
_PLAIN[0x80:] = range(0x80, 0x100)


#: Characters of scripts without spaces, each a word; and signs among them, which part words.
ALONE = (
    (0x0E00, 0x0EFF), (0x0F00, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x2E80, 0x2FDF),
    (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF),
    (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF),
)
SIGNS = (
    (0x3000, 0x3004), (0x3008, 0x3020), (0x302A, 0x3030), (0xFE10, 0xFE1F), (0xFE30, 0xFE4F),
    (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65),
)


def _within(points: np.ndarray, bounds: tuple) -> np.ndarray:
    out = np.zeros(len(points), bool)
    for low, high in bounds:
        out |= (points >= low) & (points <= high)
    return out


class PlainWords(Words):
    """Words of letters and digits: A-Z and À-Þ lowered.

    Other characters of ASCII, the signs of Latin-1 (U+0080 to U+00BF), general punctuation
    (U+2000 to U+207F) and that of Chinese and Japanese part words; each character of a
    script without spaces is a word; all others count as letters.
    """

    def __init__(self, column: pa.Array):
        data, offsets = utf8(column)
        plain = _PLAIN[data]
        # In UTF-8, À to Þ are C3 80 to C3 9E, and à to þ lie 20 higher; × is none of them.
        for lead, nexts, size in ((0xC2, (0x80, 0xBF), 2), (0xE2, (0x80, 0x81), 3)):
            at = np.flatnonzero(plain[:-1] == lead)
            at = at[(plain[at + 1] >= nexts[0]) & (plain[at + 1] <= nexts[1])]
            for k in range(size):
                plain[at + k] = 0x20
        low = np.flatnonzero(plain[:-1] == 0xC3) + 1
        low = low[(plain[low] >= 0x80) & (plain[low] <= 0x9E) & (plain[low] != 0x97)]
        plain[low] += 0x20
        cut, at = None, np.flatnonzero(data >= 0xE0)
        if len(at):
            size = 3 + (data[at] >= 0xF0)
            tail = [data[np.minimum(at + k, len(data) - 1)].astype(np.int64) & 0x3F for k in (1, 2, 3)]
            points = ((data[at].astype(np.int64) & 0xF) << 12) | (tail[0] << 6) | tail[1]
            points = np.where(size == 4, ((points & 0x7FFF) << 6) | tail[2], points)
            sign, alone = _within(points, SIGNS), _within(points, ALONE)
            for k in range(3):
                plain[at[sign] + k] = 0x20
            cut = np.zeros(len(data) + 1, bool)
            cut[at[alone]] = cut[at[alone] + size[alone]] = True
        super().__init__(
            pa.LargeStringArray.from_buffers(
                len(column), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(plain)
            ),
            cut=cut,
        )


def window_size(n: int) -> int:
    """Words of the windows by which an item of ``n`` words is looked for."""
    w = 1
    while 2 * w + w - 1 <= n:
        w *= 2
    return w


def stride(w: int) -> int:
    """Words from a window of a text to its next."""
    return max(1, w // 4)


@lru_cache(maxsize=None)
def _sampled(w: int, walk: int) -> np.ndarray:
    """The steps of each sample of a walk over windows of ``w`` words, a row a sample.

    Insertions alone (or deletions alone) drive two walks apart the further they get. So a
    walk's samples are from a stretch of its steps, of 16, 32 and so on to all, that begins
    anywhere; there the walk sets out anew, from the word that it would be at on average.
    """
    draw, steps = np.random.default_rng([w, walk]), max(STEPS, STEPS_A_WORD * w)
    reach = [min(steps, FIRST_STEPS)]
    while reach[-1] < steps:
        reach.append(min(steps, 2 * reach[-1]))
    own = reach[walk % len(reach)]
    begin = int(draw.integers(0, steps - own + 1)) // STEPS_A_WORD * STEPS_A_WORD
    return begin + np.stack([np.sort(draw.choice(own, STEPS, replace=False)) for _ in range(SAMPLES)])


def embedded_hashes(
    h: np.ndarray,
    starts: np.ndarray,
    w: int,
    stops: np.ndarray | None = None,
    walks: int = WALKS,
    distinct: int = 1,
) -> Iterator[np.ndarray]:
    """For each walk and sample, a hash of each window ``h[start:start + w]``, cut at its stop.

    It is 0 where the steps sampled are on fewer than ``distinct`` of the window's words.
    """
    starts = starts.astype(np.int64)
    stops = starts + w if stops is None else np.minimum(starts + w, stops)
    # A whole window can't end before step w; only those that are cut have to be watched.
    cut = stops - starts < w
    groups = [(np.flatnonzero(~cut), w), (np.flatnonzero(cut), 0)]
    for walk in range(walks):
        symbols = np.append(mixed(h ^ mixed(np.array([walk + 1], np.uint64))), np.uint64(0)).view(np.int64)
        out = np.zeros((SAMPLES, len(starts)), np.uint64)
        for group, safe in groups:
            for low in range(0, len(group), WINDOWS_AT_ONCE):
                some = group[low : low + WINDOWS_AT_ONCE]
                out[:, some] = _walked(symbols, starts[some], stops[some], _sampled(w, walk), safe, distinct)
        yield from out


def _walked(symbols, starts, stops, steps, safe: int, distinct: int) -> np.ndarray:
    """Hashes of each sample of one walk over windows that don't end before step ``safe``.

    A hash is a sum over the sampled steps; at the end, whose symbol is 0, it gains nothing.
    """
    skipped = int(steps.min()) // STEPS_A_WORD  # words before the walk's first sampled step
    steps, starts, safe = steps - skipped * STEPS_A_WORD, starts + skipped, max(0, safe - skipped)
    most = int(steps.max())
    factors = (mixed(np.arange(1, most + 2, dtype=np.uint64)) | np.uint64(1)).view(np.int64)
    asked = [np.flatnonzero((steps == t).any(axis=1)).tolist() for t in range(most + 1)]
    hashes = np.zeros((len(steps), len(starts)), np.int64)
    seen = np.zeros((len(steps), len(starts)), np.int8)  # words that its steps are on
    last: list = [-1] * len(steps)
    at, bits, value = starts.copy(), np.empty_like(starts), np.empty_like(starts)
    for t in range(most + 1):
        # Where a window has ended the walk goes on unwatched: it can't come back.
        word = symbols.take(at, mode="clip")
        if asked[t]:
            np.multiply(word, factors[t], out=value)
            if t >= safe:
                value *= at < stops
            for k in asked[t]:
                hashes[k] += value
            if distinct > 1:
                for k in asked[t]:
                    seen[k] += (last[k] != at) & (at < stops)
                    last[k] = at.copy()
        # A walk has more steps than a word has bits: each 64 steps they are mixed anew.
        if t >= 64:
            word = mixed(word.view(np.uint64) + np.uint64(t >> 6)).view(np.int64)
        np.right_shift(word, t & 63, out=bits)
        bits &= 1
        at += bits
    if distinct > 1:
        hashes[seen < distinct] = 0
    return hashes.view(np.uint64)


def _trials(n: int, edits: int, w: int, draw: np.random.Generator) -> tuple[list, list]:
    """Items of ``n`` words, and texts that hold each with so many edits and go on after it.

    The edits are, in turn, of all kinds, substitutions, insertions and deletions.
    """
    new = lambda k: draw.integers(1, 1 << 63, k).tolist()
    items, texts = [], []
    for trial in range(TRIALS):
        words = new(n)
        items.append(list(words))
        one = trial % KINDS
        kinds = draw.integers(1, KINDS, edits) if one == 0 else np.full(edits, one)
        # From the back, so that each place is one of the item's words.
        places = np.sort(draw.choice(n, edits, replace=False))[::-1]
        for at, word, kind in zip(places.tolist(), new(edits), kinds.tolist(), strict=True):
            words[at : at + (kind != 2)] = [] if kind == 3 else [word]
        texts.append(new(int(draw.integers(stride(w)))) + words + new(w))
    return items, texts


@lru_cache(maxsize=None)
def walks_needed(w: int, percent: int, min_words: int, recall: float = RECALL) -> tuple[int, int]:
    """Walks, and words of an item that a sample has to be on, to reach the recall by windows of ``w``.

    Of items with ``n * (100 - percent) // 100`` edits, for the shortest that ``w`` is for, as
    longer ones have more windows; several, as the share of edits varies by the rounding. It
    is reached for each of these lengths and, over them all, for each kind of edit. The
    texts go on after the item: where one ends, cut windows of both may be alike, too.
    """
    low = max(1, w + w // 2 - 1, min_words)
    lengths = range(low, max(low, min(3 * w - 2, low + (9 if w <= 16 else 2))) + 1)
    draw = np.random.default_rng([w, percent, min_words])
    tables = []
    for n in lengths:
        sides = []
        for rows, gap in zip(_trials(n, n * (100 - percent) // 100, w, draw), (1, stride(w)), strict=True):
            ends = np.cumsum([len(r) for r in rows])
            counts = -(-np.diff(ends, prepend=0) // gap)
            trial = np.repeat(np.arange(len(rows)), counts)
            first = np.concatenate(([0], ends[:-1]))
            starts = first[trial] + ranges(np.zeros(len(rows), np.int64), counts) * gap
            sides.append((np.array([x for r in rows for x in r], np.uint64), starts, ends[trial], trial))
        tables.append(sides)
    for distinct in range(DISTINCT, 0, -1):
        found = np.zeros((len(lengths), TRIALS), bool)
        hashes = [
            [
                embedded_hashes(h, starts, w, ends, MOST_WALKS, least)
                for (h, starts, ends, _), least in zip(sides, (distinct, 1), strict=True)
            ]
            for sides in tables
        ]
        for walk in range(1, MOST_WALKS + 1):
            for k, (sides, pair) in enumerate(zip(tables, hashes, strict=True)):
                for _ in range(SAMPLES):
                    keys = [next(one) for one in pair]
                    tagged = [
                        np.where(x > 0, mixed(x ^ mixed(trial.astype(np.uint64) + np.uint64(1))), np.uint64(0))
                        for x, (_, _, _, trial) in zip(keys, sides, strict=True)
                    ]
                    hit = (tagged[0] > 0) & np.isin(tagged[0], tagged[1])
                    found[k, sides[0][3][hit]] = True
            of_kind = found.reshape(len(lengths), -1, KINDS).mean(axis=(0, 1))
            if min(found.mean(axis=1).min(), of_kind.min()) >= recall:
                return walk, distinct
    raise ValueError(f"no number of walks finds items with {100 - percent} % of their words edited")


@dataclass
class Items:
    """A block of benchmark items, ready to be looked for."""

    ids: list
    words: np.ndarray  # hashes of all items' words
    first: np.ndarray
    tables: dict  # window size -> walks, and for each walk and sample, sorted hashes, the
    # words at which their windows begin, and which first bits of a hash occur
    item: np.ndarray  # of each word
    short: dict  # words of an item looked for verbatim -> sorted hashes and their items
    min_words: int

    @classmethod
    def of(
        cls,
        ids: list,
        texts: list[str],
        min_words: int,
        percent: int = PERCENT,
        min_verbatim_words: int = MIN_VERBATIM_WORDS,
    ) -> Items:
        words = PlainWords(pa.array(texts, pa.large_string()))
        h, tables = words.hashes(), {}
        size = np.array([window_size(n) if n >= min_words else 0 for n in words.counts.tolist()])
        for w in sorted(set(size.tolist()) - {0}):
            chosen = np.flatnonzero(size == w)
            counts = words.counts[chosen]
            item = np.repeat(chosen, counts)
            starts = ranges(words.first[chosen], counts)
            walks, distinct = walks_needed(w, percent, min_words)
            rows = []
            for keys in embedded_hashes(h, starts, w, words.first[item + 1], walks, distinct):
                order = np.argsort(keys)
                order = order[np.searchsorted(keys[order], 1) :]  # 0 is no hash
                known = keys[order]
                # Eight to sixteen times as many places as hashes, to rule most others out.
                first_bits = max(16, (16 * len(known)).bit_length() - 1)
                some = np.zeros(1 << first_bits, bool)
                some[known >> np.uint64(64 - first_bits)] = True
                rows.append((known, starts[order].astype(np.uint32), some, np.uint64(64 - first_bits)))
            tables[w] = walks, rows
        short = {}
        for n in sorted(set(words.counts.tolist()) & set(range(max(1, min_verbatim_words), min_words))):
            chosen = np.flatnonzero(words.counts == n)
            keys = sequence_hashes(h, n)[words.first[chosen]]
            order = np.argsort(keys)
            short[n] = keys[order], chosen[order]
        return cls(ids, h, words.first, tables, words.text.astype(np.int32), short, min_words)


def _candidates(items: Items, words: Words, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, item, and the word of the text at which the item would begin."""
    found: list[tuple[np.ndarray, ...]] = []
    for w, (walks, rows) in items.tables.items():
        step = stride(w)
        counts = -(-words.counts // step)
        text = np.repeat(np.arange(len(counts)), counts)
        starts = words.first[text] + ranges(np.zeros(len(counts), np.int64), counts) * step
        stops = words.first[text + 1]
        begins = starts - words.first[text]
        hashes = embedded_hashes(h, starts, w, stops, walks)
        for keys, (known, first, some, shift) in zip(hashes, rows, strict=True):
            if not len(known):
                continue
            hit = np.flatnonzero(some[keys >> shift])
            low = np.searchsorted(known, keys[hit])
            same = known[np.minimum(low, len(known) - 1)] == keys[hit]
            hit, low = hit[same], low[same]
            many = np.searchsorted(known, keys[hit], side="right") - low
            window = first[ranges(low, many)].astype(np.int64)
            item = items.item[window].astype(np.int64)
            begin = np.repeat(begins[hit], many) - (window - items.first[item])
            found.append((np.repeat(text[hit], many), item, begin))
    for n, (known, item) in items.short.items():
        counts = np.maximum(0, words.counts - n + 1)
        text = np.repeat(np.arange(len(counts)), counts)
        begin = ranges(np.zeros(len(counts), np.int64), counts)
        keys = sequence_hashes(h, n)[words.first[text] + begin]
        low = np.searchsorted(known, keys)
        many = np.searchsorted(known, keys, side="right") - low
        rows = np.repeat(np.arange(len(keys)), many)
        own = item[ranges(low, many)]
        # The first place of each item in a text will do.
        _, first = np.unique(text[rows] * len(items.ids) + own, return_index=True)
        found.append((text[rows[first]], own[first], begin[rows[first]]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _distances(item: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Edits from ``item`` to the best words that end at each place; a row a place's words.

    Column j is for the words that end before the j-th one; where they begin is free.
    """
    n, wide = places.shape
    column = np.arange(wide + 1, dtype=np.int32)
    row = np.zeros((n, wide + 1), np.int32)
    for k, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[:, 0] = k
        np.minimum(row[:, :-1] + (places != word), row[:, 1:] + 1, out=new[:, 1:])
        # A deletion to the left costs one a word: a running minimum without the slope.
        row = np.minimum.accumulate(new - column, axis=1) + column
    return row


def leaks_of(items: Items, column: pa.Array, percent: int) -> dict[str, np.ndarray]:
    """The best place of each item in each text of ``column`` that holds it."""
    words = PlainWords(column)
    h = words.hashes()
    text, item, begin = _candidates(items, words, h)
    length = np.diff(items.first)
    most = np.where(length < items.min_words, 0, length * (100 - percent) // 100)
    out: dict[str, list] = {k: [] for k in ("text", "item", "edits", "start", "end")}
    if len(text):
        slack = np.maximum(1, most)
        cell = begin // slack[item]
        base, wide = int(cell.min()), int(cell.max() - cell.min()) + 1
        n = len(words.counts)
        key = np.unique((item * n + text) * wide + cell - base)
        rows = np.stack((key // wide // n, key // wide % n, key % wide + base))
        bounds = np.searchsorted(rows[0], np.arange(len(length) + 1))
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            own = rows[:, bounds[k] : bounds[k + 1]]
            wide = int(length[k] + 3 * slack[k])
            some = max(1, VERIFY_CELLS // wide)
            for lo in range(0, own.shape[1], some):
                _verify(items, words, h, k, own[1, lo : lo + some], own[2, lo : lo + some] * slack[k] - slack[k], wide, int(most[k]), out)
    got = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}
    order = np.lexsort((got["start"], got["edits"], got["item"], got["text"]))
    got = {k: v[order] for k, v in got.items()}
    pair = np.stack((got["text"], got["item"]))
    best = np.ones(pair.shape[1], bool)
    best[1:] = (pair[:, 1:] != pair[:, :-1]).any(axis=0)
    return {k: v[best] for k, v in got.items()}


def _verify(items, words, h, k, text, low, wide, most, out) -> None:
    """Add the places of item ``k`` in the texts' words from ``low`` on, if near enough."""
    item = items.words[items.first[k] : items.first[k + 1]]
    at = words.first[text][:, None] + low[:, None] + np.arange(wide)
    inside = (at >= words.first[text][:, None]) & (at < words.first[text + 1][:, None])
    places = np.where(inside, h[np.clip(at, 0, len(h) - 1)], np.uint64(0))
    # All words of the item but the edited ones have to be there.
    known = np.sort(item)
    present = known[np.minimum(np.searchsorted(known, places), len(known) - 1)] == places
    full = np.flatnonzero(present.sum(axis=1) >= len(item) - most)
    if not len(full):
        return
    text, low, places = text[full], low[full], places[full]
    ends = _distances(item, places)
    stop = ends.argmin(axis=1)
    edits = ends[np.arange(len(text)), stop]
    near = np.flatnonzero(edits <= most)
    if not len(near):
        return
    # Backwards from where it ends, for where it begins.
    back = np.where(
        (stop[near, None] - 1 - np.arange(wide)) >= 0,
        places[near[:, None], np.maximum(stop[near, None] - 1 - np.arange(wide), 0)],
        np.uint64(0),
    )
    reverse = _distances(item[::-1], back)
    size = reverse.argmin(axis=1)
    out["text"].append(text[near])
    out["item"].append(np.full(len(near), k))
    out["edits"].append(edits[near].astype(np.int64))
    out["start"].append(np.maximum(0, low[near] + stop[near] - size))
    out["end"].append(np.minimum(words.counts[text[near]], low[near] + stop[near]))


def _blocks(
    benchmark: DataFrame,
    id_col: str,
    text_col: str,
    block_bytes: int,
    min_words: int,
    percent: int,
    min_verbatim_words: int,
):
    """The items, broadcast in blocks that the driver and each worker can hold."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(
        "text is not null"
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()
        if rows:
            made = Items.of(
                [r.id for r in rows], [r.text for r in rows], min_words, percent, min_verbatim_words
            )
            yield benchmark.sparkSession.sparkContext.broadcast(made)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    min_verbatim_words: int = MIN_VERBATIM_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, item_id, n_words, edits, start_word, end_word``: items that rows hold.

    A row holds an item of n words if it has adjacent words from which at most
    ``(100 - percent) * n / 100`` insertions, deletions or substitutions of words lead to
    the item; the best place is given. Words are runs of letters and digits, without case,
    and single characters in scripts without spaces. Items of fewer than ``min_words`` words
    say too little for edits and are looked for verbatim; those of fewer than
    ``min_verbatim_words``, as "Yes", are in too many texts to say anything, and are not
    looked for.

    Null or empty texts hold nothing, null items or items with a null id are not looked
    for. Repeated rows and items are each reported. Rows are read whole, nothing is
    shuffled. A pass over ``docs`` looks for about ``block_bytes`` of items, so a larger
    benchmark takes several passes, not a larger broadcast. The table that is broadcast has
    20 to 28 bytes for each word, walk and sample: 75 to 190 times the items' text.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    doc_kind = narrow.schema["doc_id"].dataType.simpleString()
    item_type = benchmark.schema[item_id_col].dataType.simpleString()
    schema = (
        f"doc_id {doc_kind}, item_id {item_type}, n_words bigint, edits bigint, "
        "start_word bigint, end_word bigint"
    )

    def run(shared):
        def found(batches) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                for part in slices(batch, "text"):
                    got = leaks_of(items, part["text"], percent)
                    item = got["item"].astype(np.int64)
                    columns = [
                        part["doc_id"].take(pa.array(got["text"].astype(np.int64))),
                        pa.array([items.ids[k] for k in item.tolist()], _arrow(item_type)),
                        pa.array(np.diff(items.first)[item]),
                        *(pa.array(got[c].astype(np.int64)) for c in ("edits", "start", "end")),
                    ]
                    yield pa.RecordBatch.from_arrays(
                        columns, ["doc_id", "item_id", "n_words", "edits", "start_word", "end_word"]
                    )

        return found

    out = docs.sparkSession.createDataFrame([], schema)
    benchmark = benchmark.where(F.col(item_id_col).isNotNull())
    for items in _blocks(
        benchmark, item_id_col, item_text_col, block_bytes, min_words, percent, min_verbatim_words
    ):
        out = out.unionByName(narrow.mapInArrow(run(items), schema))
    return out


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    min_verbatim_words: int = MIN_VERBATIM_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that hold no item in the sense of ``leaks``, all columns as they are.

    Items with a null id are looked for as well. Null and empty texts stay, and so do all
    copies of a repeated row that stays. No rows give none.
    """

    def run(shared):
        def clean(batches) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                for part in slices(batch, text_col):
                    keep = np.ones(part.num_rows, bool)
                    keep[leaks_of(items, part[text_col], percent)["text"].astype(np.int64)] = False
                    yield part.filter(pa.array(keep))

        return clean

    for items in _blocks(
        benchmark, item_id_col, item_text_col, block_bytes, min_words, percent, min_verbatim_words
    ):
        docs = docs.mapInArrow(run(items), docs.schema)
    return docs
