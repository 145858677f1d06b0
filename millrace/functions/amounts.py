"""Exact sums of money held in double columns.

A sum of doubles depends on the order of the rows, so a retried task or another
partitioning can change its last digits, and at a few hundred billion rows those
reach the cents. Here each amount becomes a whole number of small parts before it
is summed, which makes the total exact and the same on every run.

A ``bigint`` total of such parts can overflow on one hot key, and a wide decimal
is slow in a hash aggregate with many groups. So an amount is summed as two
``bigint`` columns, its high bits and its low bits, and the two sums are put
together as a decimal once the groups are few.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW_BITS = 20

# In parts. Wide enough for the last digits of a double that stands for a number
# of cents (1.1400000000000001), far too narrow for another amount.
TOLERANCE = 1e-3

# The double and its product with the parts are each off by up to one in 2**53. Below
# this many parts that is less than half a part together, so the count is the right one.
MOST_PARTS = float(2**51)

# A total in parts has up to 26 digits, and two more when it is rounded to cents.
MOST_PER_UNIT = 10**18


def whole_parts(column: Column, per_unit: int) -> Column:
    """``column`` (double) as a ``bigint`` count of parts, ``per_unit`` to the unit.

    Null where it is null, and where it is refused: no whole number of parts, too many to be
    exact, or NaN. What is refused has to be counted, or a total would lack it without a
    word; see ``refused``.
    """
    unit = F.lit(float(per_unit))
    whole = F.rint(column * unit)
    # Compared in units, where a double that stands for whole parts differs by nothing.
    rest = F.abs(whole / unit - column) * unit
    return F.when((rest <= TOLERANCE) & (F.abs(whole) < MOST_PARTS), whole.cast("bigint"))


def refused(value: Column, parts: Column) -> Column:
    """Whether ``value`` is not null and its ``parts`` are."""
    return value.isNotNull() & parts.isNull()


def high_low_names(name: str) -> list[str]:
    return [f"{name}_high", f"{name}_low"]


def high_low(parts: Column, name: str) -> list[Column]:
    """Split a ``bigint`` so that ``high * 2**LOW_BITS + low`` gives it back.

    The low half is never negative, so both halves may be summed on their own.
    """
    high, low = high_low_names(name)
    return [
        F.shiftright(parts, LOW_BITS).alias(high),
        parts.bitwiseAND(F.lit(2**LOW_BITS - 1).cast("bigint")).alias(low),
    ]


def high_low_total(name: str, per_unit: int, digits: int) -> Column:
    """The sum held by the two columns of ``name``, in units, as double.

    Rounded once, halves away from zero, to ``digits``, then the nearest double. All is done
    on whole numbers of parts: the quotient of two decimals would be cut to the digits that
    fit, and rounding that could round twice.
    """
    if not 1 <= per_unit <= MOST_PER_UNIT:
        raise ValueError(f"parts of 1/{per_unit} are not supported, only to 1/{MOST_PER_UNIT}")
    high, low = (F.col(c).cast("decimal(19,0)") for c in high_low_names(name))
    parts = high * F.lit(2**LOW_BITS) + low
    size = (F.abs(parts) * F.lit(10**digits)).cast("decimal(38,0)")
    unit = F.lit(per_unit).cast("decimal(19,0)")
    over = (size % unit).cast("decimal(19,0)")
    # The division leaves nothing over.
    steps = ((size - over) / unit).cast("decimal(35,0)") + F.when(over * 2 >= unit, 1).otherwise(0)
    rounded = (steps * F.lit(Decimal(10) ** -digits)).cast("double")
    return F.when(parts < 0, -rounded).otherwise(rounded)
