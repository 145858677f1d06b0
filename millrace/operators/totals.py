"""Sums per key, taken before a join so that a hot key never crosses it.

A sum over joined rows equals the sum over the join of per-key sums. Totalling
first means that the rows of one key are combined in the task that reads them,
and each task sends at most one row per key to the shuffle. The join then finds
one row per key on that side, and its input is already partitioned on the key.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that go with the measures: how many amounts were refused, and one of them.
N_REFUSED, REFUSED = "n_refused", "refused"


def total_by(frame: DataFrame, keys: str | list[str], measures: Iterable[str]) -> DataFrame:
    """Sum each measure (``bigint``) per value of ``keys``, and what was refused of them.

    Only these columns are kept. A sum that does not fit is null and counts as refused, with
    ANSI arithmetic on or off: whoever shows a group has to look at ``n_refused`` first.
    """
    sums, lost = [], F.lit(0).cast("bigint")
    for m in measures:
        total = F.try_sum(m)
        sums.append(total.alias(m))
        lost = lost + F.when(total.isNull() & (F.count(m) > 0), 1).otherwise(0)
    keys = [keys] if isinstance(keys, str) else keys
    return frame.groupBy(*keys).agg(
        *sums, (F.sum(N_REFUSED) + lost).alias(N_REFUSED), F.max(REFUSED).alias(REFUSED)
    )
