import random
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from millrace.functions import high_low, high_low_names, high_low_total, refused, whole_parts


def doubles(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x double")


def test_every_number_of_cents_is_read_exactly(spark):
    cents = spark.range(0, 2_000_000).select("id", (F.col("id") / 100).alias("x"))
    wrong = cents.where(whole_parts(F.col("x"), 100) != F.col("id"))
    assert wrong.count() == 0


def test_large_amounts_are_read_exactly_up_to_the_limit(spark):
    stride = (2**51 - 17) // 1_000_000
    parts = spark.range(1_000_000).select((F.col("id") * stride + 17).alias("n"))
    for sign in (1, -1):
        n = F.col("n") * sign
        wrong = parts.where(whole_parts((n / 100).cast("double"), 100) != n)
        assert wrong.count() == 0


def test_signs_nulls_and_large_amounts(spark):
    rows = doubles(spark, -0.07, None, 0.0, 123456789012.34).select(
        whole_parts(F.col("x"), 100).alias("p")
    )
    assert [r.p for r in rows.collect()] == [-7, None, 0, 12345678901234]


@pytest.mark.parametrize("value", [0.001, 1.005, -88e9 - 0.005, 2**51 / 100, 1e17, float("nan"), float("inf")])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_anything_else_is_refused(spark, conf, value, ansi):
    conf("spark.sql.ansi.enabled", ansi)
    parts = whole_parts(F.col("x"), 100)
    row = doubles(spark, value).select(parts.alias("p"), refused(F.col("x"), parts).alias("r")).first()
    assert (row.p, row.r) == (None, True)


@pytest.mark.parametrize("value", [0, 1, -1, 2**20, -(2**20), 2**20 - 1, 2**62 + 12345, -(2**62) - 1])
def test_halves_give_the_number_back(spark, value):
    halves = spark.range(1).select(*high_low(F.lit(value).cast("bigint"), "m")).first()
    assert halves.m_high * 2**20 + halves.m_low == value
    assert 0 <= halves.m_low < 2**20


def test_a_total_beyond_bigint(spark):
    n, part = 40_000, 2**50 + 3
    total = (
        spark.range(n)
        .select(*high_low(F.lit(part).cast("bigint"), "m"))
        .agg(*[F.sum(c).alias(c) for c in high_low_names("m")])
        .select(high_low_total("m", 100, 2).alias("t"))
        .first()
        .t
    )
    assert n * part > 2**63
    assert total == float(Decimal(n * part) / 100)


def test_rounding_is_done_once(spark):
    """4,999,999,960 parts of 1/10**12 are 0.00499999996, which is nearer to 0 than to a cent."""
    draw = random.Random(7)
    cases = [(4_999_999_960, 10**12), (5 * 10**9, 10**12), (-5 * 10**9, 10**12), (-5 * 10**9 + 1, 10**12)]
    for digits in range(19):
        unit = 10**digits
        cases += [(draw.randrange(-(2**62), 2**62), unit) for _ in range(3)]
        cases += [(draw.randrange(min(10**6, 2**61 // unit)) * unit + unit // 200 + d, unit) for d in (-1, 0, 1)]
        cases += [(draw.randrange(10**9), draw.randrange(1, 10**12))]
    for parts, unit in cases:
        got = spark.range(1).select(*high_low(F.lit(parts).cast("bigint"), "m"))
        got = got.select(high_low_total("m", unit, 2).alias("t")).first().t
        with localcontext(prec=100):
            right = (Decimal(parts) / unit).quantize(Decimal("0.01"), ROUND_HALF_UP)
        assert got == float(right), (parts, unit)


def test_parts_too_fine_to_be_rounded_are_refused(spark):
    with pytest.raises(ValueError, match="not supported"):
        high_low_total("m", 10**19, 2)
