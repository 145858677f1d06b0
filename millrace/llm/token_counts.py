"""Token counts of the documents in flat token files that have no index.

A flat file is a row of ids of fixed width, each document ended by one id. Files follow one
another as one stream; a document may reach over blocks and files. Blocks are searched for
the end id on their own, in numpy. What a block has before its first end belongs to a
document that began earlier: prefix scans over the blocks' few numbers, first within a file
and then over files, give where each block lies in the stream, how many documents ended
before it, and where the last of these ended.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.arrays import slices
from millrace.llm.library_bpe import library_cache
from millrace.llm.shared import new_folder, written

BLOCK_BYTES = 8 << 20


def write_flat(
    docs: DataFrame,
    path: str,
    end: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the ids of all texts to flat files of 16-bit ids, each text ended by ``end``.

    Gives ``doc_id, file, path, place`` for each row: its file, and its place in it. This
    says nothing of lengths; it only names the documents that the files hold in order. A
    null or empty text is the end id alone. Special tokens that stand in a text are encoded
    as ordinary text, so the one that ends documents can't be taken for an end. Files are
    those of the input's partitions; nothing is shuffled.
    """
    folder = new_folder(docs.sparkSession, "flat")
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        cache, part, place, out = library_cache(path, False), TaskContext.get().partitionId(), 0, None
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
        for batch in batches:
            for rows in slices(batch, "text"):
                n = rows.num_rows
                texts = rows["text"].fill_null("").to_pylist()
                ids, counts = cache.texts(texts)
                if len(ids) and (int(ids.max()) >= 1 << 16 or (ids == end).any()):
                    raise ValueError("an id of a text is the end id or does not fit in 16 bits")
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(np.insert(ids.astype("<u2"), np.cumsum(counts), end).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        rows["doc_id"],
                        pa.array(np.full(n, part, np.int64)),
                        pa.array([f"{folder}/{name}"] * n),
                        pa.array(np.arange(place, place + n)),
                    ],
                    ["doc_id", "file", "path", "place"],
                )
                place += n
        if out is not None:
            out.close()

    return written(
        narrow.mapInArrow(run, "doc_id bigint, file bigint, path string, place bigint"), "placed"
    )


def _sized(batches, width: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            fs, path = FileSystem.from_uri(row["path"])
            size = fs.get_file_info(path).size
            if size % (width // 8):
                raise ValueError(f"{path} ends within an id")
            n = -(-size // block_bytes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["file"]] * n, pa.int64()), pa.array([row["path"]] * n, pa.string()), pa.array(range(n), pa.int64())],
                ["file", "path", "block"],
            )


def _scanned(batches, end: int, width: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    dtype = np.dtype({16: "<u2", 32: "<u4"}[width])
    for batch in batches:
        for row in batch.to_pylist():
            fs, path = FileSystem.from_uri(row["path"])
            with fs.open_input_file(path) as f:
                ids = np.frombuffer(f.read_at(block_bytes, row["block"] * block_bytes), dtype)
            ends = np.flatnonzero(ids == end)
            starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
            docs = pa.StructArray.from_arrays(
                [pa.array(starts, pa.int32()), pa.array(ends - starts, pa.int32())], ["at", "n"]
            )
            lists = pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), docs)
            last = int(ends[-1]) + 1 if len(ends) else None
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["file"]], pa.int64()),
                    pa.array([row["block"]], pa.int64()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([len(ends)], pa.int64()),
                    pa.array([last], pa.int64()),
                    lists,
                ],
                ["file", "block", "n_ids", "n_ends", "last", "docs"],
            )


def token_counts(
    files: DataFrame, end: int, width: int = 16, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``ordinal, start, n_tokens, ended`` of each document in ``files (file, path)``.

    Files make one stream in the order of ``file``. ``ordinal`` counts documents from 0,
    ``start`` is the place of the first id in the stream, ``n_tokens`` leaves the end id
    out. Ids after the last end are a document that is not ``ended``. Two ends in a row are
    a document of no tokens; empty files and no files give none. A file that ends within an
    id fails. A task holds one block; ``block_bytes`` has to be a multiple of an id's bytes.
    """
    if block_bytes <= 0 or block_bytes % (width // 8):
        raise ValueError(f"blocks of {block_bytes} bytes do not hold whole ids")
    n = max(1, files.count())
    blocks = files.select(F.col("file").cast("bigint").alias("file"), "path").repartition(n).mapInArrow(
        lambda b: _sized(b, width, block_bytes), "file bigint, path string, block bigint"
    )
    scanned = written(
        blocks.repartition("file", "block").mapInArrow(
            lambda b: _scanned(b, end, width, block_bytes),
            "file bigint, block bigint, n_ids bigint, n_ends bigint, last bigint, "
            "docs array<struct<at: int, n: int>>",
        ),
        "scanned",
    )
    numbers = scanned.drop("docs")

    def scan(frame: DataFrame, window) -> DataFrame:
        """Ids and ends before each row, and where the last end before it is."""
        before = window.rowsBetween(Window.unboundedPreceding, -1)
        placed = frame.withColumn("ids_before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
        return placed.withColumns(
            {
                "ends_before": F.coalesce(F.sum("n_ends").over(before), F.lit(0)),
                "last_before": F.max(F.col("ids_before") + F.col("last")).over(before),
            }
        )

    in_file = scan(numbers, Window.partitionBy("file").orderBy("block"))
    # One row for each file from here on.
    totals = in_file.groupBy("file").agg(
        F.sum("n_ids").alias("n_ids"),
        F.sum("n_ends").alias("n_ends"),
        F.max(F.col("ids_before") + F.col("last")).alias("last"),
    )
    of_file = scan(totals, Window.orderBy("file"))
    base = of_file.select("file", *(F.col(c).alias(f"file_{c}") for c in ("ids_before", "ends_before", "last_before")))
    placed = in_file.join(base, "file").select(
        "file",
        "block",
        (F.col("file_ids_before") + F.col("ids_before")).alias("begin"),
        (F.col("file_ends_before") + F.col("ends_before")).alias("ordinal_0"),
        F.coalesce(
            F.greatest("file_last_before", F.col("file_ids_before") + F.col("last_before")), F.lit(0)
        ).alias("open_since"),
    )
    docs = (
        scanned.select("file", "block", F.posexplode("docs").alias("k", "doc"))
        .join(placed, ["file", "block"])
        .select(
            (F.col("ordinal_0") + F.col("k")).alias("ordinal"),
            F.when(F.col("k") == 0, F.col("open_since"))
            .otherwise(F.col("begin") + F.col("doc.at"))
            .alias("start"),
            (F.col("begin") + F.col("doc.at") + F.col("doc.n")).alias("stop"),
        )
        .select("ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(True).alias("ended"))
    )
    whole = of_file.agg(
        F.sum("n_ids").alias("stop"),
        F.sum("n_ends").alias("ordinal"),
        F.coalesce(F.max(F.col("ids_before") + F.col("last")), F.lit(0)).alias("start"),
    ).where("stop > start")
    rest = whole.select("ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return docs.unionByName(rest)


def document_token_counts(docs: DataFrame, path: str, end: int, **names: str) -> DataFrame:
    """``doc_id, ordinal, start, n_tokens`` of each row of ``docs``, from flat files of it.

    The files are written by ``write_flat`` and read by ``token_counts``; a row finds its
    count by its place among all documents of the stream.
    """
    placed = write_flat(docs, path, end, **names)
    files = placed.groupBy("file", "path").agg(F.count("*").alias("n"))
    counts = token_counts(files, end)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    first = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    named = placed.join(first, "file").select("doc_id", (F.col("before") + F.col("place")).alias("ordinal"))
    return named.join(counts, "ordinal").select("doc_id", "ordinal", "start", "n_tokens")
