"""Files between steps, in the folder that driver and executors share.

A step whose result is used twice, or that a loop builds on, is written as Parquet and
read again: this cuts the lineage, and a lost executor costs nothing that was written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of this machine only where it is unset.

    The setting is a cluster's. A local session, as in tests, has none and one machine.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="millrace-"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to a new place in the shared folder, and read from there."""
    spark, path = frame.sparkSession, new_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
