"""Joins on keys of which some may be on a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1024  # a key is hot if it is on this part of the rows, so at most so many are


def hot_join(
    rows: DataFrame,
    facts: DataFrame,
    counts: DataFrame,
    keys: list[str],
    spread: str,
    how: str = "inner",
    more: tuple[str, ...] = (),
) -> DataFrame:
    """``rows`` joined with ``facts`` on ``keys`` and ``more``.

    ``counts`` has for each of ``keys`` the number ``n`` of its rows (what is wrong or missing
    there moves work, not results). Rows of a hot key are dealt by ``spread`` to as many tasks
    as it has shares, and its facts are copied to each. At most ``SHARE`` keys are hot: those
    alone are broadcast. ``counts`` is read three times, so it should be written; it and
    ``facts`` have no null keys.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(2, -(-total // SHARE))
    copies = F.ceil(F.col("n") / least).cast("int")
    hot = F.broadcast(counts.where(F.col("n") >= least).select(*keys, copies.alias("hot_copies")))
    place = F.pmod(F.xxhash64(spread), F.col("hot_copies")).cast("int")
    dealt = rows.join(hot, keys, "left").withColumn("hot_salt", F.coalesce(place, F.lit(0))).drop("hot_copies")
    salts = F.sequence(F.lit(0), F.coalesce("hot_copies", F.lit(1)) - 1)
    copied = facts.join(hot, keys, "left").withColumn("hot_salt", F.explode(salts)).drop("hot_copies")
    return dealt.join(copied, [*keys, *more, "hot_salt"], how).drop("hot_salt")
