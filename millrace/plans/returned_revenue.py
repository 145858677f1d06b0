"""Revenue of returned lines by region and order year."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import high_low, high_low_names, high_low_total, refused, whole_parts
from millrace.operators import N_REFUSED, REFUSED, total_by
from millrace.sources import read_table

START = datetime(1996, 1, 1)
END = datetime(1998, 1, 1)
RETURNED = "R"

# In the given tables prices are whole cents and discounts whole percent.
CENTS = 100
PERCENT = 100


def returned_revenue(
    lineitem: DataFrame,
    orders: DataFrame,
    customer: DataFrame,
    nation: DataFrame,
    region: DataFrame,
    start: datetime = START,
    end: datetime = END,
    flag: str = RETURNED,
    price_parts: int = CENTS,
    discount_parts: int = PERCENT,
) -> DataFrame:
    """Count and revenue of the lines with ``flag`` ordered in ``[start, end)``.

    ``r_name string, o_year bigint, n_lines bigint, revenue double``, a row for each
    region and year that has lines, sorted on both. Inner joins throughout.

    A price has to be a whole number of ``1 / price_parts``, a discount one of
    ``1 / discount_parts``; pass finer parts for finer amounts. Other amounts, and those
    too large to be exact, are counted on the way, and the query fails if a group that it
    returns has one. Lines outside the result fail nothing. None of this depends on ANSI.

    ``start`` and ``end`` are wall times, as the order dates are; zoned ones are an error.

    Each step totals on the key it joins on next, with the year once it is known. No hint is
    given; Spark broadcasts a side whose size is below
    ``spark.sql.autoBroadcastJoinThreshold`` and sort-merges otherwise.
    """
    if start.tzinfo is not None or end.tzinfo is not None:
        raise ValueError(f"start {start} and end {end} have to be wall times, without a zone")
    if start >= end:
        raise ValueError(f"start {start} is not before end {end}")
    measures = ["n_lines", *high_low_names("revenue")]

    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    lines = (
        lineitem.where(F.col("l_returnflag") == flag)
        .withColumns(
            {
                "price": whole_parts(price, price_parts),
                "paid": F.lit(discount_parts) - whole_parts(discount, discount_parts),
            }
        )
        .withColumn("amount", F.try_multiply("price", "paid"))
    )
    bad = (
        F.when(refused(price, F.col("price")), price)
        .when(refused(discount, F.col("paid")), discount)
        .when(F.col("price").isNotNull() & refused(F.col("paid"), F.col("amount")), price)
    )
    lines = lines.select(
        "l_orderkey",
        F.lit(1).cast("bigint").alias("n_lines"),
        *high_low(F.col("amount"), "revenue"),
        bad.isNotNull().cast("bigint").alias(N_REFUSED),
        bad.alias(REFUSED),
    )
    placed = orders.where(
        (F.col("o_orderdate") >= _ntz(start)) & (F.col("o_orderdate") < _ntz(end))
    ).select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("bigint").alias("o_year"))

    per_order = total_by(lines, "l_orderkey", measures)
    per_customer = total_by(
        per_order.join(placed, F.col("l_orderkey") == F.col("o_orderkey")),
        ["o_custkey", "o_year"],
        measures,
    )
    per_nation = total_by(
        per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey")),
        ["c_nationkey", "o_year"],
        measures,
    )
    per_region = total_by(
        per_nation.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
            region, F.col("n_regionkey") == F.col("r_regionkey")
        ),
        ["r_name", "o_year"],
        measures,
    )
    message = F.concat(
        F.lit(f"an amount is not a whole number of 1/{price_parts} parts (a discount: "),
        F.lit(f"1/{discount_parts}) or too large for an exact sum: "),
        F.coalesce(F.col(REFUSED).cast("string"), F.lit("a total")),
    )
    revenue = high_low_total("revenue", price_parts * discount_parts, 2)
    return per_region.select(
        "r_name",
        "o_year",
        "n_lines",
        F.when(F.col(N_REFUSED) > 0, F.raise_error(message)).otherwise(revenue).alias("revenue"),
    ).orderBy(F.asc_nulls_last("r_name"), "o_year")


def returned_revenue_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``returned_revenue`` over the tables in ``sf_dir``, whole."""
    names = ("lineitem", "orders", "customer", "nation", "region")
    return returned_revenue(*(read_table(spark, sf_dir, name) for name in names))


def _ntz(moment: datetime):
    # A datetime literal would be a zoned timestamp and depend on the session zone.
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
