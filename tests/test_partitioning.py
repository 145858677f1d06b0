"""The result does not depend on how rows are split; stored buckets save a shuffle."""

import re
from contextlib import redirect_stdout
from io import StringIO

import pytest
from oracle import assert_same

import __spark_entry__ as contract
from millrace.plans import returned_revenue
from millrace.sources import read_table

SF_DIR = "/root/testdata/sf0.01"
SQL = contract.oracle_sql()["returned_revenue_by_region_year"]
NAMES = ("lineitem", "orders", "customer", "nation", "region")


def tables(spark):
    return [read_table(spark, SF_DIR, name) for name in NAMES]


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("input_parts, shuffle_parts", [(1, 1), (5, 3), (37, 11)])
def test_any_split_of_the_rows_gives_the_same_digits(
    spark, conf, adaptive, input_parts, shuffle_parts
):
    conf("spark.sql.adaptive.enabled", adaptive)
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.shuffle.partitions", str(shuffle_parts))
    frames = [frame.repartition(input_parts) for frame in tables(spark)]
    assert_same(returned_revenue(*frames), SF_DIR, SQL)


def test_tables_bucketed_on_the_order_key_are_joined_where_they_lie(spark, conf, tmp_path):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    lineitem, orders, *rest = tables(spark)
    stored = []
    for frame, key in ((lineitem, "l_orderkey"), (orders, "o_orderkey")):
        name = f"bucketed_{key}"
        path = str(tmp_path / name)
        frame.write.bucketBy(8, key).option("path", path).saveAsTable(name)
        stored.append(name)
    result = returned_revenue(*map(spark.table, stored), *rest)
    with redirect_stdout(StringIO()) as printed:
        result.explain()
    shuffled = re.findall(r"Exchange hashpartitioning\((\w+)#", printed.getvalue())
    assert "l_orderkey" not in shuffled and "o_orderkey" not in shuffled
    assert "o_custkey" in shuffled and "c_custkey" in shuffled
    assert_same(result, SF_DIR, SQL)
    for name in stored:
        spark.sql(f"DROP TABLE {name}")
