"""The corpus pipeline: each stage works on all that the one before it kept.

Stages take nulls in any column, empty texts, repeated rows, columns of any further names and
an empty table, and say below what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import bpe_encode
from millrace.llm.decontaminate import without_leaks
from millrace.llm.minhash import without_near_duplicates
from millrace.llm.pii import sanitise
from millrace.llm.quality import passing
from millrace.llm.queries import BYTE_BPE
from millrace.llm.shared import written
from millrace.sources import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null, empty and blank texts go."""
    return passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Repeated rows and rows of a null id take part; null, empty and blank texts all stay.
    """
    return without_near_duplicates(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null and empty texts hold none."""
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that disclose it taken out.

    Terms that are with a value in one text alone are judged, too: near copies are gone, so
    most values are in one. ``n_chars`` is that of the new text; a null or empty text stays as it is.
    """
    clean = sanitise(docs, support=1)
    return clean.withColumn("n_chars", F.length("text").cast("bigint"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document that is left: ``doc_id, ids``; none for a null or empty text."""
    return bpe_encode(docs, BYTE_BPE)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("bpe", encode),
]

#: Suffix arrays, near-duplicates, edit distance and BPE are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's rows are written and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
