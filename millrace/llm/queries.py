"""One query for each operator, over the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import bpe_digests
from millrace.llm.chat import PERSPECTIVES_SQL, perspectives
from millrace.llm.decontaminate import leaks
from millrace.llm.fill_in_middle import FILL_IN_MIDDLE_SQL, fill_in_middle, with_restored
from millrace.llm.hard_negatives import HARD_NEGATIVES_SQL, hard_negatives
from millrace.llm.language import held_out, identify, train
from millrace.llm.minhash import NEAR_DUPLICATES_SQL, near_duplicates
from millrace.llm.pii import find_personal_data
from millrace.llm.quality import QUALITY_SQL, quality_rules
from millrace.llm.substring_dedup import SUBSTRING_DEDUP_SQL, without_repeats
from millrace.llm.token_counts import document_token_counts
from millrace.llm.token_records import read_records, write_records
from millrace.llm.warc import derive, write_responses
from millrace.sources import read_table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    docs = read_table(spark, sf_dir, "documents")
    return bpe_digests(docs, BYTE_BPE).withColumn("doc_id", F.col("doc_id").cast("bigint"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, item_id, n_words, edits, start_word, end_word``: passages of the benchmark."""
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("text_hash")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    docs = read_table(spark, sf_dir, "documents")
    told = identify(docs, train(docs))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue, rendered for each of its participants, a row for each message."""
    return perspectives(read_table(spark, sf_dir, "conversations"))


END_OF_TEXT = 50256  # the special token of the vocabulary
RECORD_END = 2


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, ordinal, start, n_tokens`` of every document, from flat token files."""
    return document_token_counts(read_table(spark, sf_dir, "documents"), BYTE_BPE, END_OF_TEXT)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, digests and counts of the records derived from every page."""
    derived = derive(write_responses(read_table(spark, sf_dir, "pages")))
    return derived.drop("metadata_path", "metadata_offset", "conversion_path", "conversion_offset")


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from record files."""
    manifest = write_records(read_table(spark, sf_dir, "documents"), BYTE_BPE, RECORD_END)
    return read_records(manifest, digest=True)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every document."""
    return quality_rules(read_table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, places and digest of the personal data of every document."""
    return find_personal_data(read_table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""
    told = without_repeats(read_table(spark, sf_dir, "documents"), digest=True)
    return told.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, sizes and digests of every document, rearranged and restored."""
    made = with_restored(fill_in_middle(read_table(spark, sf_dir, "documents")))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every anchor's positives, from all vectors."""
    rows = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_decontaminate": op2_decontaminate,
    "op3_minhash": op3_minhash,
    "op4_language": op4_language,
    "op5_chat": op5_chat,
    "op6_token_counts": op6_token_counts,
    "op7_warc": op7_warc,
    "op8_token_records": op8_token_records,
    "op9_quality": op9_quality,
    "op10_personal_data": op10_personal_data,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_hard_negatives": op13_hard_negatives,
}

#: The others' results are beyond SQL; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_minhash": NEAR_DUPLICATES_SQL,
    "op5_chat": PERSPECTIVES_SQL,
    "op9_quality": QUALITY_SQL,
    "op11_substring_dedup": SUBSTRING_DEDUP_SQL,
    "op12_fill_in_middle": FILL_IN_MIDDLE_SQL,
    "op13_hard_negatives": HARD_NEGATIVES_SQL,
}
