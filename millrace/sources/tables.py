"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table, a single file or a directory of part files.

    The schema comes from the files (one footer is read, whatever the size).
    A declared schema would turn a missing column into nulls instead of an error.
    """
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
