"""Exact comparison of a Spark result with the same query in DuckDB."""

from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

DUCKDB_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE"}


def run_sql(sf_dir, sql):
    with duckdb.connect() as con:
        for name in TABLES:
            con.execute(f"CREATE VIEW {name} AS FROM read_parquet('{sf_dir}/{name}.parquet')")
        result = con.execute(sql)
        schema = [(d[0], str(d[1])) for d in result.description]
        return schema, result.fetchall()


def assert_same(frame, sf_dir, sql):
    """Same columns, types and rows, each as often, in the same order; no tolerance."""
    schema, expected = run_sql(sf_dir, sql)
    assert [(name, DUCKDB_TYPES[kind]) for name, kind in frame.dtypes] == schema
    actual = [tuple(row) for row in frame.collect()]
    assert actual
    assert Counter(actual) == Counter(expected)
    assert actual == expected
