import itertools
import math
import random

import pytest
from cases import collected
from pyspark.sql import functions as F

from millrace.llm.hard_negatives import bounds, hard_negatives, windowed

KIND = "vec_id bigint, embedding array<float>, label int, is_anchor boolean"


def brute_force(rows, n_positives=5, n_negatives=10, low=30, high=90):
    def fine(r):
        return None not in r[:3] and all(x is not None and math.isfinite(x) for x in r[1])

    rows = {(r[0], tuple(r[1]), r[2], bool(r[3])) for r in rows if fine(r)}
    whole = {r: [math.floor(256 * x) for x in r[1]] for r in rows}
    out = []
    for a in rows:
        if not a[3]:
            continue
        score = {
            r: sum(x * y for x, y in zip(whole[a], whole[r], strict=True))
            for r in rows
            if r[0] != a[0] and len(r[1]) == len(a[1])
        }
        order = sorted(score, key=lambda r: (-score[r], r[0]))
        for p in [r for r in order if r[2] == a[2]][:n_positives]:
            fits = [r for r in order if r[2] != a[2] and low * score[p] <= 100 * score[r] <= high * score[p]]
            out += [(a[0], p[0], k, r[0], score[p], score[r]) for k, r in enumerate(fits[:n_negatives], 1)]
    return sorted(out)


def frame(spark, rows, parts=3):
    made = spark.createDataFrame(rows, KIND)
    others = ("id", "row", "block", "size", "score", "negative", "key", "anchor_id", "vector", "positive_scores")
    return made.withColumns({c: F.lit("x") for c in others}).repartition(parts)


def mined(spark, rows, **options):
    return sorted(collected(hard_negatives(frame(spark, rows), F.col("is_anchor"), **options)))


def drawn(n, size, seed, most=2):
    """Vectors of few values, so that scores tie and are often 0 or negative."""
    draw = random.Random(seed)
    value = lambda: draw.randint(-most, most) / 4
    return [(k, [value() for _ in range(size)], draw.choice([0, 0, 0, 1, 2]), k % 7 == 0) for k in range(n)]


@pytest.mark.parametrize("size, most", [(2, 1), (4, 2), (8, 3)])
def test_against_brute_force(spark, size, most):
    rows = drawn(150, size, size, most)
    expected = brute_force(rows)
    assert mined(spark, rows) == expected and len(expected) > 100
    assert mined(spark, rows, block_rows=11) == expected
    few = {"n_positives": 2, "n_negatives": 1, "low": -50, "high": 100}
    assert mined(spark, rows, block_rows=40, **few) == brute_force(rows, 2, 1, -50, 100)


def test_rows_of_all_kinds(spark):
    rows = drawn(60, 3, 1)
    odd = [
        (None, [1.0, 1.0, 1.0], 0, True),
        (100, None, 0, True),
        (101, [1.0, None, 0.0], 0, True),
        (102, [float("nan"), 0.0, 0.0], 0, True),
        (103, [float("inf"), 0.0, 0.0], 1, True),
        (104, [0.5, 0.5, 0.5], None, True),
        (105, [0.5, 0.5, 0.5], 0, None),
        (106, [0.5], 0, True),
        (107, [0.25], 0, False),
        (108, [0.2], 1, False),
        (109, [], 0, True),
        (110, [], 1, False),
        (111, [], 0, False),
        (0, [0.75, 0.5, 0.25], 1, True),  # another row of an id, and another anchor
        (7, rows[7][1], rows[7][2], rows[7][3]),
        (7, rows[7][1], rows[7][2], rows[7][3]),
    ]
    assert mined(spark, rows + odd, block_rows=9) == brute_force(rows + odd)
    assert mined(spark, []) == []
    assert mined(spark, [r[:3] + (False,) for r in rows]) == []
    assert mined(spark, [(1, [1.0], 0, True)]) == []


def test_scores_beyond_what_doubles_hold(spark):
    rows = [(1, [3e6, 1.0], 0, True), (2, [3e6, 2.0], 0, False), (3, [2e6, 1.0], 1, False), (4, [2e6, 3.0], 1, False)]
    assert mined(spark, rows) == brute_force(rows) and 256 * 256 * 9 * 10**12 > 1 << 53
    huge = [(1, [1e30], 0, True), (2, [1e30], 0, False)]
    with pytest.raises(Exception, match="does not fit in 64 bits"):
        mined(spark, huge)


def test_a_row_on_a_third_of_the_table(spark):
    rows = drawn(60, 3, 2)
    assert mined(spark, rows + [rows[1]] * 2000, block_rows=16) == brute_force(rows)


def test_windows_hold_scores_as_stated():
    for p, low, high in itertools.product(range(-40, 41), (0, 30, 33), (66, 90, 100)):
        a, b = bounds(p, low, high)
        assert [s for s in range(-50, 50) if a <= s <= b] == [s for s in range(-50, 50) if low * p <= 100 * s <= high * p]


def test_an_anchor_is_read_as_a_stream():
    read = 0

    def stream():
        nonlocal read
        yield (1, 0, 10**9, False, 1)
        for k in range(10**6):
            read += 1
            yield (1, 0, 8 * 10**8 - k, True, k)

    rows = windowed(stream(), 3, 30, 90)
    assert next(rows) == (1, 1, 1, 0, 10**9, 8 * 10**8) and read == 1


def test_scores_are_dealt_by_anchor(spark, capsys):
    hard_negatives(frame(spark, drawn(30, 2, 0)), F.col("is_anchor")).explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(anchor_id" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
