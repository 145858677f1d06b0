"""Hard negatives by a secondary-sort shuffle.

Scores of anchors and rows are packed into keys (anchor, descending score, kind, id), dealt
by anchor and sorted by key within each partition; an iterator reads an anchor's scores from
the highest down. Its first positives each open a window of scores; a negative goes to the
windows that it lies in, until these are full. So an anchor is never gathered: what is held
is its open windows. (In a tie a positive comes first, as its window may hold its own score.)

Anchors meet rows in blocks: a task holds one block of rows, of bounded size, and all anchors
pass it by. Before the shuffle a block drops what can't be in the result: all but its best
positives of each anchor, and then, as windows are known from the positives, all but each
window's first negatives. So an anchor has a few scores from each block, not one a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import written

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90
SCALE = 256
BLOCK_ROWS = 1 << 16
LEAST_ROWS = 1 << 10
BLOCK_ANCHORS = 256  # whose scores of a block a task holds at once
EXACT = float(1 << 53)

SCORES = "anchor_id bigint, anchor_row bigint, score bigint, negative boolean, id bigint"
_SCORES = [c.split()[0] for c in SCORES.split(", ")]
MINED = (
    "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
    "positive_score bigint, negative_score bigint"
)
_MINED = [c.split()[0] for c in MINED.split(", ")]


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    """Rows of vectors of one ``size``, of whole numbers in doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).reshape(len(column), size)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of ``a`` and ``b``.

    Doubles hold them as long as no sum can pass 2**53; beyond, Python's integers do.
    """
    most = (np.abs(a).max(initial=0.0) or 1.0) * (np.abs(b).max(initial=0.0) or 1.0) * max(1, a.shape[1])
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
    got = whole[0].dot(whole[1].T)
    if got.size and max(abs(int(x)) for x in got.flat) >= 1 << 63:
        raise ValueError("a score does not fit in 64 bits")
    return got.astype(np.int64)


def _first(order_score: np.ndarray, ids: np.ndarray, chosen: np.ndarray, n: int) -> np.ndarray:
    """Which of ``chosen`` have the ``n`` highest scores, of equal ones the smallest ids."""
    if len(chosen) > n:
        score = order_score[chosen]
        # All that tie with the n-th highest stay until ids decide.
        least = np.partition(score, len(score) - n)[len(score) - n]
        chosen = chosen[score >= least]
    return chosen[np.lexsort((ids[chosen], -order_score[chosen]))[:n]]


class _Block:
    """A block of rows, by the size of their vectors; their ids ascend."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        lengths = table["size"].to_numpy()
        ids, labels = table["id"].to_numpy(), table["label"].to_numpy()
        self.parts = {}
        for size in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == size)
            at = at[np.argsort(ids[at], kind="stable")]
            vectors = _vectors(table["vector"].combine_chunks().take(pa.array(at)), size)
            self.parts[size] = ids[at], labels[at], vectors

    def scores(self, anchors: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each anchor, its place in ``anchors``, and ids, labels and scores of the rows."""
        lengths = anchors["size"].to_numpy()
        for size, (ids, labels, vectors) in self.parts.items():
            at = np.flatnonzero(lengths == size)
            for some in np.array_split(at, max(1, -(-len(at) // BLOCK_ANCHORS))):
                if len(some):
                    own = _vectors(anchors["vector"].combine_chunks().take(pa.array(some)), size)
                    for k, score in zip(some.tolist(), inner_products(own, vectors), strict=True):
                        yield k, ids, labels, score


def _met(batches, best) -> Iterator[pa.RecordBatch]:
    """What ``best`` keeps of the scores of each block's rows and the anchors it meets."""
    block, number = None, None
    held: list[pa.Table] = []

    def rows_of(table: pa.Table):
        out = best(table, block)
        if out is not None:
            yield out

    for batch in batches:
        table = pa.Table.from_batches([batch])
        numbers = table["block"].to_numpy()
        for lo, hi in _runs(numbers):
            if numbers[lo] != number:
                number, block, held = numbers[lo], None, []
            part = table.slice(lo, hi - lo)
            kinds = part["is_anchor"].to_numpy(zero_copy_only=False).astype(bool)
            cut = int(np.argmax(kinds)) if kinds.any() else len(kinds)
            if cut:
                held.append(part.slice(0, cut))
            if cut < len(kinds):
                if block is None:
                    if not held:  # no row has fallen into this block
                        continue
                    block, held = _Block(pa.concat_tables(held)), []
                yield from rows_of(part.slice(cut).combine_chunks())


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    bounds = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True]))) if len(values) else []
    return list(zip(bounds[:-1], bounds[1:], strict=True)) if len(values) else []


def _of(rows: list[tuple]) -> pa.RecordBatch | None:
    """Scores ``(anchor's id and row, scores, negative, ids)`` as a batch."""
    if not rows:
        return None
    counts = [len(r[4]) for r in rows]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat([r[0] for r in rows], counts), pa.int64()),
            pa.array(np.repeat([r[1] for r in rows], counts), pa.int64()),
            pa.array(np.concatenate([r[2] for r in rows]), pa.int64()),
            pa.array(np.repeat([r[3] for r in rows], counts), pa.bool_()),
            pa.array(np.concatenate([r[4] for r in rows]), pa.int64()),
        ],
        _SCORES,
    )


def _best_positives(n: int):
    def best(anchors: pa.Table, block: _Block):
        ids, row = anchors["id"].to_numpy(), anchors["row"].to_numpy()
        labels, rows = anchors["label"].to_numpy(), []
        for k, other, label, score in block.scores(anchors):
            chosen = np.flatnonzero((label == labels[k]) & (other != ids[k]))
            chosen = _first(score, other, chosen, n)
            rows.append((ids[k], row[k], score[chosen], False, other[chosen]))
        return _of(rows)

    return best


def _best_negatives(n: int, low: int, high: int):
    """Negatives that are among the first ``n`` of a block in one of the anchor's windows."""

    def best(anchors: pa.Table, block: _Block):
        ids, row = anchors["id"].to_numpy(), anchors["row"].to_numpy()
        labels, rows = anchors["label"].to_numpy(), []
        windows = anchors["positive_scores"].to_pylist()
        for k, other, label, score in block.scores(anchors):
            different = np.flatnonzero((label != labels[k]) & (other != ids[k]))
            own, chosen = score[different], []
            for positive in set(windows[k]):
                floor, top = bounds(positive, low, high)
                chosen.append(_first(score, other, different[(own >= floor) & (own <= top)], n))
            if chosen and len(at := np.unique(np.concatenate(chosen))):
                rows.append((ids[k], row[k], score[at], True, other[at]))
        return _of(rows)

    return best


def bounds(positive: int, low: int, high: int) -> tuple[int, int]:
    """The smallest and largest whole score with low*p <= 100*score <= high*p."""
    return -(-low * positive // 100), high * positive // 100


def _sorted(scores: DataFrame) -> DataFrame:
    """The secondary sort: dealt by anchor, in order of the packed key within partitions."""
    key = F.struct("anchor_id", "anchor_row", (-F.col("score")).alias("down"), "negative", "id")
    return scores.withColumn("key", key).repartition("anchor_id").sortWithinPartitions("key").drop("key")


def _streamed(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[c].to_pylist() for c in _SCORES), strict=True)


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = 8192):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def first_positives(stream, n: int) -> Iterator[tuple]:
    """The first ``n`` scores of each anchor of a sorted stream."""
    anchor, seen = None, 0
    for row in stream:
        if row[:2] != anchor:
            anchor, seen = row[:2], 0
        if seen < n:
            seen += 1
            yield row


def windowed(stream, n: int, low: int, high: int) -> Iterator[tuple]:
    """Rows of the result from a sorted stream of positives and negatives.

    ``windows``: of each positive of the anchor its id, score, bounds and negatives so far.
    """
    anchor, windows = None, []
    for own, own_row, score, negative, id_ in stream:
        if (own, own_row) != anchor:
            anchor, windows = (own, own_row), []
        if not negative:
            windows.append([id_, score, *bounds(score, low, high), 0])
            continue
        windows = [w for w in windows if w[4] < n and score >= w[2]]  # the others are closed
        for w in windows:
            if score <= w[3]:
                w[4] += 1
                yield own, w[0], w[4], id_, w[1], score


def hard_negatives(
    rows: DataFrame,
    is_anchor,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    n_positives: int = POSITIVES,
    n_negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components are taken as ``floor(256 * x)``; a row's score for an anchor is their integer
    inner product, rows being in order of score, highest first, and then of id. An anchor's
    positives are its first ``n_positives`` other rows of its label. For each, the first
    ``n_negatives`` rows of another label are given whose score lies from ``low`` to ``high``
    percent of the positive's (none if that is negative); ``rank`` counts them from 1.
    ``is_anchor`` is a condition on ``rows``.

    Rows with a null id or label, or a vector that is null or has a null or non-finite
    component, take no part; vectors of different lengths have no score. Repeated rows are
    one. Rows of one id that differ are different rows and different anchors, and none is a
    positive or negative of an anchor of its own id. No rows give none. A score beyond 64
    bits fails.

    Anchors are a stated set: all rows meet all of them, so work grows with rows times
    anchors. Rows are dealt by a hash into blocks of about ``block_rows``, or fewer where
    that leaves cores idle, and each anchor is sent to every block twice.
    """
    vector = F.col(vector_col)
    if rows.schema[vector_col].dataType.simpleString() != "array<float>":
        vector = vector.cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    table = written(
        rows.select(
            F.col(id_col).cast("bigint").alias("id"),
            F.col(label_col).alias("label"),
            vector.alias("vector"),
            F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
            fine.alias("fine"),
        )
        .where("id is not null and label is not null and vector is not null and fine")
        .drop("fine")
        .withColumns({"size": F.size("vector"), "row": F.xxhash64("id", "label", "vector")})
        .distinct(),
        "vectors",
    )
    n = table.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n_blocks = max(1, -(-n // block_rows), min(cores, -(-n // LEAST_ROWS)))
    block = F.pmod("row", F.lit(n_blocks)).cast("int")
    columns = ["block", "is_anchor", "id", "row", "label", "size", "vector", "positive_scores"]
    none = F.lit(None).cast("array<bigint>")
    base = table.withColumns({"block": block, "is_anchor": F.lit(False), "positive_scores": none}).select(*columns)

    def met(anchors: DataFrame, best) -> DataFrame:
        everywhere = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
        passing = anchors.withColumn("block", everywhere).withColumn("is_anchor", F.lit(True))
        dealt = base.unionByName(passing.select(*columns)).repartition(n_blocks, "block")
        return dealt.sortWithinPartitions("block", "is_anchor").mapInArrow(
            lambda batches: _met(batches, best), SCORES
        )

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
    mined = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    anchors = table.where("is_anchor")
    positives = written(
        _sorted(met(anchors.withColumn("positive_scores", none), _best_positives(n_positives))).mapInArrow(
            lambda b: _batches(first_positives(_streamed(b), n_positives), _SCORES, kinds), SCORES
        ),
        "positives",
    )
    windows = positives.groupBy("anchor_id", "anchor_row").agg(
        F.collect_list("score").alias("positive_scores")
    )
    same = (F.col("id") == F.col("anchor_id")) & (F.col("row") == F.col("anchor_row"))
    known = anchors.drop("positive_scores").join(windows, same)
    negatives = met(known, _best_negatives(n_negatives, low, high))
    return _sorted(positives.unionByName(negatives)).mapInArrow(
        lambda b: _batches(windowed(_streamed(b), n_negatives, low, high), _MINED, mined), MINED
    )


HARD_NEGATIVES_SQL = """
    WITH rows AS (
        SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scores AS (
        SELECT a.id AS anchor_id, r.id, a.label = r.label AS same,
               CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
        FROM rows a JOIN rows r ON a.id % 100 = 0 AND a.id <> r.id
    ), positives AS (
        SELECT anchor_id, id AS positive_id, score AS positive_score
        FROM scores WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
    )
    SELECT anchor_id, positive_id, negative_id, positive_score, negative_score,
           CAST(k AS INTEGER) AS rank
    FROM (SELECT p.anchor_id, positive_id, s.id AS negative_id, positive_score,
                 s.score AS negative_score,
                 row_number() OVER (PARTITION BY p.anchor_id, positive_id
                                    ORDER BY s.score DESC, s.id) AS k
          FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
           AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
    WHERE k <= 10
"""
