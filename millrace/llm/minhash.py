"""Near-duplicates by min-max hashing.

Each permutation of the shingles' hashes gives two values of a set's signature, its minimum
and its maximum, so half as many permutations are evaluated as the signature has values.
Rows with equal sets are one class; what follows works on classes. Bands of signature values
put classes into buckets; a bucket ties its classes to the smallest of them, which takes one
row each and no pairs. What is tied together, directly or through others, is a candidate
group, and holds each link that the bands can find. Groups are compared in blocks of bounded
size inside tasks: signatures first, and where these don't rule a link out, the full sets.
Only links that join what was not joined yet leave a task.

A group of several blocks is compared within each block, every one with the group's leader.
What the blocks find meets in the leader alone, so each class's piece is known without
another search for components. Where a group isn't of one piece, each class outside its
largest piece is compared with all of the group, again by blocks: no link is lost, whatever
the size of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import Words, mixed, slices
from millrace.llm.components import components
from millrace.llm.hot_keys import hot_join
from millrace.llm.shared import written

PERMUTATIONS = 63
WORDS = 5
BLOCK_CLASSES = 1024
BLOCK_SHINGLES = 500_000
MOST_MISSED = 1e-6
#: Standard deviations of a signature's estimate below the threshold, to rule a link out.
DEVIATIONS = 5.0


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    draws = mixed(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64))
    return draws[:PERMUTATIONS] | np.uint64(1), draws[PERMUTATIONS:]


def rows_per_band(percent: int, values: int = 2 * PERMUTATIONS) -> int:
    """The most values in a band with which a link at the threshold is all but never missed."""
    share = percent / 100
    fits = [r for r in range(1, 17) if (1 - share**r) ** (values // r) <= MOST_MISSED]
    return max(fits, default=1)


def shingles(words: Words, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, and where each text's begin.

    A text with fewer words than ``size`` has one, of all its words; without words, none.
    """
    h, n = words.hashes(), len(words.counts)
    counts = np.where(words.counts >= size, words.counts - size + 1, np.minimum(words.counts, 1))
    text = np.repeat(np.arange(n), counts)
    total = np.cumsum(counts)
    start = np.arange(len(text)) - np.repeat(total - counts, counts) + words.first[text]
    stop = words.first[text + 1]
    value = np.zeros(len(text), np.uint64)
    for k in range(size):
        at = start + k
        here = at < stop
        part = np.where(here, h[np.minimum(at, max(len(h) - 1, 0))], np.uint64(0x5851F42D4C957F2D))
        value = mixed(value * np.uint64(0xD6E8FEB86659FD93) + part)
    of_text = mixed(value + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    new = ~pd.Series(of_text).duplicated().to_numpy()
    return value[new], np.searchsorted(text[new], np.arange(n + 1))


def signatures(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each set under each permutation; ``uint32``, a row a set.

    No set may be empty.
    """
    out = np.empty((len(first) - 1, 2 * PERMUTATIONS), np.uint32)
    a, b = _permutations()
    for k in range(PERMUTATIONS):
        value = ((sets * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32)
        out[:, 2 * k] = np.minimum.reduceat(value, first[:-1])
        out[:, 2 * k + 1] = np.maximum.reduceat(value, first[:-1])
    return out


def _set_keys(sets: np.ndarray, first: np.ndarray) -> list[bytes]:
    """128 bits that stand for each set, whatever its order; no set may be empty."""
    one = np.add.reduceat(mixed(sets), first[:-1])
    other = np.bitwise_xor.reduceat(mixed(sets ^ np.uint64(0xA0761D6478BD642F)), first[:-1])
    raw = np.stack((one, mixed(other + np.diff(first).astype(np.uint64))), axis=1).tobytes()
    return [raw[k : k + 16] for k in range(0, len(raw), 16)]


def _described(batches, size: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets, first = shingles(Words(part["text"], lower=True), size)
            counts = np.diff(first)
            full = np.flatnonzero(counts)
            keys: list = [None] * len(counts)
            bands: list = [None] * len(counts)
            sketches: list = [None] * len(counts)
            if len(full):
                own = np.append(first[:-1][full], len(sets))
                told = signatures(sets, own)
                bounds = range(0, told.shape[1] - rows + 1, rows)
                band = np.empty((len(full), len(bounds)), np.uint64)
                for j, low in enumerate(bounds):
                    value = np.full(len(full), j, np.uint64)
                    for k in range(low, low + rows):
                        value = mixed(value * np.uint64(0xD6E8FEB86659FD93) + told[:, k])
                    band[:, j] = value
                sketch = (told & 0xFF).astype(np.uint8)
                for k, key, b, s in zip(full, _set_keys(sets, own), band.view(np.int64), sketch, strict=True):
                    keys[k], bands[k], sketches[k] = key, b, s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"],
                    part["text_hash"],
                    pa.array(counts.astype(np.int64)),
                    pa.array(keys, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sketches, pa.binary()),
                ],
                ["doc_id", "text_hash", "n_shingles", "set_key", "bands", "sketch"],
            )


def whole_groups(batches, columns: list[str], most: int) -> Iterator[pa.Table]:
    """Tables that hold all rows of their groups; rows come sorted by ``columns``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and size >= most:
            last = [held[-1][c][-1].as_py() for c in columns]
            same = np.ones(batch.num_rows, bool)
            for c, v in zip(columns, last, strict=True):
                same &= np.array([x == v for x in batch[c].to_pylist()])
            stop = int(np.argmin(same)) if not same.all() else batch.num_rows
            held.append(batch.slice(0, stop))
            if stop < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                batch = batch.slice(stop)
            else:
                continue
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


class _Joined:
    """What is joined with what, among ``n`` things."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, k: int) -> int:
        parent = self.parent
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def _least_agreement(percent: int) -> float:
    """Below this share of equal signature values, a link is ruled out."""
    share = percent / 100
    return share - DEVIATIONS * np.sqrt(share * (1 - share) / (2 * PERMUTATIONS))


def _spread(column: str, n: str):
    return F.pmod(F.xxhash64(column), F.col(n)).cast("int")


def _block_pairs():
    """The pairs of blocks that a row belongs to: i of ``m_blocks`` of the minor ones, j of
    ``n_blocks`` of all. A pair of blocks is one task's work."""
    i, j = _spread("set_key", "m_blocks"), _spread("set_key", "n_blocks")
    all_i, all_j = (F.sequence(F.lit(0), F.col(n) - 1) for n in ("m_blocks", "n_blocks"))
    name = lambda x, y: F.concat_ws("/", x.cast("string"), y.cast("string"))
    of_all = F.transform(all_i, lambda x: name(x, j))
    of_minor = F.transform(all_j, lambda y: name(i, y))
    return F.array_distinct(F.when(F.col("minor"), F.concat(of_all, of_minor)).otherwise(of_all))


def _compared(batches, size: int, percent: int, pieces: bool) -> Iterator[pa.RecordBatch]:
    """Edges ``a, b`` between classes of each block (``grp, block``) that links join.

    Rows with ``piece`` equal are joined already. With ``minor``, only pairs of which one
    is minor are compared. With ``pieces``, edges lead from each class to the name of its
    piece: the group's leader if that is in it, else the smallest class.
    """
    least = _least_agreement(percent)
    for table in whole_groups(batches, ["grp", "block"], 4 << 20):
        table = table.combine_chunks()
        block = pd.factorize(
            pd.MultiIndex.from_arrays([table["grp"].to_pylist(), table["block"].to_pylist()])
        )[0]
        bounds = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
        made_a, made_b = [], []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            part = table.slice(lo, hi - lo)
            for a, b in _links_of(part, size, percent, least, pieces):
                made_a.append(a)
                made_b.append(b)
        yield pa.RecordBatch.from_arrays(
            [pa.array(made_a, pa.binary()), pa.array(made_b, pa.binary())], ["a", "b"]
        )


def _links_of(
    part: pa.Table, size: int, percent: int, least: float, as_pieces: bool
) -> list[tuple[bytes, bytes]]:
    seen: set[bytes] = set()
    keep = []
    wanted = part["set_key"].to_pylist()
    words = Words(part["text"].combine_chunks(), lower=True)
    sets, first = shingles(words, size)
    full = np.flatnonzero(np.diff(first))
    told = dict(zip(full.tolist(), _set_keys(sets, np.append(first[:-1][full], len(sets))) if len(full) else [], strict=True))
    for k, key in enumerate(wanted):
        # A row of the same id but another text isn't the one meant; a repeated one adds nothing.
        if told.get(k) == key and key not in seen:
            seen.add(key)
            keep.append(k)
    n = len(keep)
    if n < 2:
        return []
    keys = [wanted[k] for k in keep]
    own = [np.sort(sets[first[k] : first[k + 1]]) for k in keep]
    counts = np.array([len(s) for s in own], np.int64)
    sketch = np.frombuffer(b"".join(part["sketch"].take(keep).to_pylist()), np.uint8).reshape(n, -1)
    pieces = part["piece"].take(keep).to_pylist()
    minor = np.array(part["minor"].take(keep).to_pylist(), bool)
    joined, edges, head = _Joined(n), [], {}
    for k, piece in enumerate(pieces):
        if piece is not None:
            joined.join(head.setdefault(piece, k), k)
    for i in range(n - 1):
        rest = slice(i + 1, n)
        agree = (sketch[rest] == sketch[i]).mean(axis=1)
        small = np.minimum(counts[rest], counts[i])
        large = np.maximum(counts[rest], counts[i])
        near = (agree >= least) & (100 * small >= percent * large) & (minor[rest] | minor[i])
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if joined.root(i) == joined.root(j):
                continue
            both = len(np.intersect1d(own[i], own[j], assume_unique=True))
            if 100 * both >= percent * (counts[i] + counts[j] - both):
                joined.join(i, j)
                edges.append((keys[i], keys[j]))
    if not as_pieces:
        return edges
    # The leader is the group's smallest class, so it is its piece's, too.
    name: dict[int, bytes] = {}
    for k, key in enumerate(keys):
        root = joined.root(k)
        name[root] = min(key, name.get(root, key))
    return [(key, own) for k, key in enumerate(keys) if (own := name[joined.root(k)]) != key]


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = WORDS,
    percent: int = 85,
    block_classes: int = BLOCK_CLASSES,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_hash`` for each row of ``docs``.

    A row's set holds the distinct shingles of ``size`` words of its whole text, A-Z lowered,
    words being ``[^\\x20\\x09-\\x0D]+``; with fewer words the whole sequence; without words
    it is empty and linked with nothing. Rows are linked where
    ``100 * intersection >= percent * union``. ``component_id`` is the smallest id reachable,
    ``kept`` says whether it is the row's own; ``text_hash`` is ``xxhash64`` of the text.

    Repeated rows share a class, and those with the smallest id are all kept. Rows of one id
    with different texts are compared as different rows. A row with a null id is linked
    with nothing and kept; its ``component_id`` is null. Other columns are not read.

    A link at the threshold is missed by all bands with a chance of at most 1e-6.
    """
    rows = rows_per_band(percent)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    told = written(
        narrow.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
            lambda batches: _described(batches, size, rows),
            f"doc_id {kind}, text_hash bigint, n_shingles bigint, set_key binary, bands array<bigint>, sketch binary",
        ),
        "described",
    )
    classes = written(
        told.where("doc_id is not null and set_key is not null")
        .groupBy("set_key")
        .agg(
            F.min(F.struct("doc_id", "text_hash")).alias("rep"),
            *(F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")),
        ),
        "classes",
    )
    banded = classes.select("set_key", F.explode("bands").alias("band"))
    buckets = written(
        banded.groupBy("band").agg(F.min("set_key").alias("b"), F.count("*").alias("n")).where("n > 1"),
        "buckets",
    )
    ties = hot_join(banded, buckets.select("band", "b"), buckets, ["band"], "set_key")
    groups = written(components(ties.select(F.col("set_key").alias("a"), "b")), "groups")

    pieces = _pieces(narrow, classes, groups, size, percent, block_classes, block_shingles)
    pieced = classes.select("set_key", F.col("rep.doc_id").alias("rep")).join(
        pieces, F.col("set_key") == F.col("node"), "left"
    ).select("set_key", "rep", F.coalesce("component", "set_key").alias("piece"))
    smallest = pieced.groupBy("piece").agg(F.min("rep").alias("of_class"))
    of_class = pieced.join(smallest, "piece").select("set_key", "of_class")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("of_class"))
    return (
        told.select("doc_id", "text_hash", "n_shingles", "set_key")
        .join(of_class, "set_key", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
            "text_hash",
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _pieces(docs, classes, groups, size, percent, block_classes, block_shingles) -> DataFrame:
    """``node, component`` of the classes that are linked with a smaller one."""
    members = groups.join(classes, groups["node"] == classes["set_key"]).select(
        F.col("component").alias("grp"), "set_key", "rep", "n_shingles", "sketch"
    )

    def blocks(frame: DataFrame, names: str) -> DataFrame:
        """How many blocks the rows of ``frame`` of each group take."""
        count = F.greatest(
            F.ceil(F.count("*") / block_classes), F.ceil(F.sum("n_shingles") / block_shingles)
        )
        return frame.groupBy("grp").agg(count.cast("int").alias(names))

    # One text for each row told apart, whatever the number of its copies. All texts are shuffled
    # for this, so both rounds read what it finds.
    one = docs.withColumn("text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "text_hash"])
    named = members.select("set_key", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_hash").alias("text_hash"))
    texts = written(named.join(one, ["doc_id", "text_hash"]).select("set_key", "text"), "texts")

    def compared(rows: DataFrame, pieces: bool) -> DataFrame:
        columns = ["grp", "block", "set_key", "sketch", "piece", "minor", "text"]
        dealt = rows.join(texts, "set_key").select(*columns).repartition("grp", "block").sortWithinPartitions("grp", "block")
        return dealt.mapInArrow(lambda b: _compared(b, size, percent, pieces), "a binary, b binary")

    # Every class with its block; a group's leader, its smallest class, is in all of them.
    placed = members.join(blocks(members, "n_blocks"), "grp")
    everywhere = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    first = placed.withColumn(
        "block",
        F.explode(
            F.when(F.col("set_key") == F.col("grp"), everywhere).otherwise(
                F.array(_spread("set_key", "n_blocks"))
            )
        ),
    ).select(
        "*", F.lit(None).cast("binary").alias("piece"), F.lit(True).alias("minor")
    )
    found = written(compared(first, True), "pieces").select(
        F.col("a").alias("node"), F.col("b").alias("component")
    )

    # Groups of several blocks that are not of one piece yet.
    several = written(placed.where("n_blocks > 1"), "several")
    if several.isEmpty():
        return found
    pieced = several.join(found, F.col("set_key") == F.col("node"), "left").withColumn(
        "piece", F.coalesce("component", "set_key")
    )
    sizes = pieced.groupBy("grp", "piece").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("grp").agg(
        F.max_by("piece", F.struct("n", "piece")).alias("main"), F.count("*").alias("n_pieces")
    )
    open_ = written(
        pieced.join(largest.where("n_pieces > 1"), "grp").withColumn(
            "minor", F.col("piece") != F.col("main")
        ).drop("node", "component"),
        "open",
    )
    if open_.isEmpty():
        return found
    outside = open_.where("minor")
    both = open_.join(blocks(outside, "m_blocks"), "grp")
    pairs = both.withColumn("block", F.explode(_block_pairs()))
    links = written(compared(pairs, False), "links")
    # Pieces of these groups that the links join; components of pieces, then of classes.
    of_piece = open_.select("set_key", "piece")
    ends = links.join(of_piece.toDF("a", "piece_a"), "a").join(of_piece.toDF("b", "piece_b"), "b")
    joined = components(ends.select(F.col("piece_a").alias("a"), F.col("piece_b").alias("b")))
    moved = of_piece.join(joined, F.col("piece") == F.col("node"), "left").select(
        F.col("set_key").alias("node"), F.coalesce("component", "piece").alias("component")
    )
    return found.join(open_.select("set_key"), F.col("node") == F.col("set_key"), "left_anti").unionByName(moved)


def without_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """One row of ``docs`` of each group that ``near_duplicates`` finds, all columns as they are.

    The row with the smallest id stays, of several the one with the smallest hash of its
    text, of repeated ones any. Rows of a null id take part and come last, so one of them
    stays only if its group has no other. Null, empty and blank texts are in no group and all
    stay. No rows give none.
    """
    id_, text = F.col(id_col), F.col(text_col)
    # As a struct an id is never null, and rows of one id with other texts are others.
    name = F.struct(id_.isNull().alias("missing"), id_.alias("id"), F.xxhash64(text).alias("h"))
    named = docs.select(name.alias("doc_id"), text.alias("text"))
    told = written(near_duplicates(named, **options).select("doc_id", "kept", "n_shingles"), "told")
    key = F.struct("missing", "id", "h").alias("row")
    gone = told.where("not kept").select("doc_id.*").distinct().select(key)
    left = docs.join(gone, name == gone["row"], "left_anti")
    repeated = written(
        told.where("kept and n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
        .select("doc_id.*").select(key),
        "repeated",
    )
    if repeated.isEmpty():
        return left
    # Those are found again by their content; one of each is the first of its copies in a task.
    others = left.join(repeated, name == repeated["row"], "left_anti")
    copies = left.join(repeated, name == repeated["row"], "left_semi")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = copies.select(name.alias("row"), whole.alias("whole")).groupBy("row").agg(F.first("whole").alias("whole"))
    return others.unionByName(one.select("whole.*"))


NEAR_DUPLICATES_SQL = r"""
    WITH RECURSIVE words AS (
        SELECT doc_id,
               regexp_extract_all(
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), shingles AS (
        SELECT DISTINCT doc_id,
               array_to_string(w[k : k + 4], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k
              FROM words WHERE len(w) > 0)
    ), sizes AS (
        SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
    ), links AS (
        SELECT a.doc_id AS x, b.doc_id AS y
        FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
        JOIN sizes n ON n.doc_id = a.doc_id JOIN sizes m ON m.doc_id = b.doc_id
        GROUP BY a.doc_id, b.doc_id, n.n, m.n
        HAVING 100 * count(*) >= 85 * (n.n + m.n - count(*))
    ), reached AS (
        SELECT doc_id AS x, doc_id AS y FROM documents
        UNION
        SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
    ), components AS (
        SELECT x, min(y) AS component_id FROM reached GROUP BY x
    )
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM documents d LEFT JOIN sizes USING (doc_id) JOIN components c ON c.x = d.doc_id
"""
