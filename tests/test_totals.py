import pytest

from millrace.operators import total_by

SCHEMA = "k string, y bigint, a bigint, b bigint, n_refused bigint, refused double"
ROWS = [
    ("p", 1, 10, 5, 0, None),
    ("p", 1, 5, None, 1, 0.5),
    ("p", 2, 7, 15, 2, 2.5),
    ("q", 2, None, 20, 0, None),
    (None, 1, 3, 40, 0, None),
    (None, 1, 4, 40, 0, None),
]


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_null_keys_are_one_group_and_null_measures_add_nothing(spark):
    totals = total_by(spark.createDataFrame(ROWS, SCHEMA), "k", ["a", "b"])
    assert totals.columns == ["k", "a", "b", "n_refused", "refused"]
    assert rows(totals) == rows(
        spark.createDataFrame(
            [("p", 22, 20, 3, 2.5), ("q", None, 20, 0, None), (None, 7, 80, 0, None)],
            totals.schema,
        )
    )


def test_two_keys(spark):
    totals = total_by(spark.createDataFrame(ROWS, SCHEMA), ["k", "y"], ["a"])
    assert ("p", 1, 15, 1, 0.5) in rows(totals) and len(rows(totals)) == 4


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_a_sum_that_does_not_fit_is_null_and_counted(spark, conf, ansi):
    conf("spark.sql.ansi.enabled", ansi)
    big = [("p", 1, 2**62, 1, 0, None)] * 2 + [("q", 1, 2**62, 1, 0, None)]
    totals = total_by(spark.createDataFrame(big, SCHEMA), "k", ["a", "b"])
    assert rows(totals) == [("p", None, 2, 1, None), ("q", 2**62, 1, 0, None)]
    # Nor does it vanish in a total of totals.
    assert rows(total_by(totals, [], ["a", "b"])) == [(2**62, 3, 1, None)]
