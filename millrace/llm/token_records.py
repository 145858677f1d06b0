"""Token ids as length-delimited binary records, with a separate index of offsets.

A record file is a row of frames: the payload's length (8 bytes), the masked checksum of
these (4), the payload, its masked checksum (4); numbers are little-endian. The checksum is
CRC-32, masked by a turn and an addition so that a checksum of data that hold checksums
stays useful. A payload is a flag (1 byte, 0 for a null id), the document's id (8) and its
token ids. The index has 16 bytes a record: the frame's offset and the number of ids. So
records can be read in any order, and a reader needs a file's index but not the file.

A task writes its rows to files named for the attempt and passes their names on as a row.
Only attempts that Spark counts become rows of the manifest; other files are never read.
"""

from __future__ import annotations

import uuid
import zlib
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

MASK = 0xA282EAD8  # the constant of the masked checksums of common record formats
HEAD = 9  # bytes of a payload before its token ids
READ_BYTES = 8 << 20
INDEX = np.dtype([("offset", "<u8"), ("n_ids", "<u8")])

MANIFEST = "part int, path string, index string, n_records bigint, n_ids bigint"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = len(payload).to_bytes(8, "little")
    return b"".join(
        (
            length,
            masked(length).to_bytes(4, "little"),
            payload,
            masked(payload).to_bytes(4, "little"),
        )
    )


def unframed(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload of the frame at ``at``, and where the next one begins."""
    length, told = data[at : at + 8], data[at + 8 : at + 12]
    if len(told) < 4 or masked(length) != int.from_bytes(told, "little"):
        raise ValueError(f"the length of the record at {at} is damaged")
    stop = at + 12 + int.from_bytes(length, "little")
    payload, told = data[at + 12 : stop], data[stop : stop + 4]
    if len(told) < 4 or masked(payload) != int.from_bytes(told, "little"):
        raise ValueError(f"the record at {at} is damaged")
    return payload, stop + 4


def _dtype(width: int) -> np.dtype:
    return np.dtype({16: "<u2", 32: "<u4"}[width])


def _written(batches, folder: str, path: str, end: int, width: int) -> Iterator[pa.RecordBatch]:
    cache, dtype = library_cache(path), _dtype(width)
    part = TaskContext.get().partitionId()
    fs, root = FileSystem.from_uri(folder)
    fs.create_dir(root)
    name = f"part-{part:06d}-{uuid.uuid4().hex}"
    offset, n_ids, records = 0, 0, None
    index: list[tuple[int, int]] = []
    for batch in batches:
        for rows in slices(batch, "text"):
            ids, counts = cache.texts(rows["text"].fill_null("").to_pylist())
            if len(ids) and int(ids.max()) >= 1 << width or end >= 1 << width:
                raise ValueError(f"ids do not fit in {width} bits")
            ids, stop = ids.astype(dtype), np.cumsum(counts)
            tail = np.array([end], dtype).tobytes()
            frames = []
            for doc, b, n in zip(rows["doc_id"].to_pylist(), stop.tolist(), counts.tolist(), strict=True):
                head = bytes([doc is not None]) + (doc or 0).to_bytes(8, "little", signed=True)
                frames.append(frame(head + ids[b - n : b].tobytes() + tail))
                index.append((offset, n + 1))
                offset += len(frames[-1])
                n_ids += n + 1
            if records is None:
                records = fs.open_output_stream(f"{root}/{name}.records", compression=None)
            records.write(b"".join(frames))
    if records is not None:
        records.close()
        with fs.open_output_stream(f"{root}/{name}.index", compression=None) as out:
            out.write(np.array(index, INDEX).tobytes())
        row = (part, f"{folder}/{name}.records", f"{folder}/{name}.index", len(index), n_ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array([v]) if k else pa.array([v], pa.int32()) for k, v in enumerate(row)],
            ["part", "path", "index", "n_records", "n_ids"],
        )


def write_records(
    docs: DataFrame,
    path: str,
    end: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 16,
) -> DataFrame:
    """Write each row's token ids and ``end`` as a record; give the manifest.

    The manifest has a row for each file: ``part, path, index, n_records, n_ids, first_id``,
    ``first_id`` being the number of ids in the files before it. Parts and the records in
    them are in ascending order of ``id_col`` (a bigint; nulls first), then of the text.
    A null or empty text has the end id alone. Repeated rows are repeated records; no rows
    make no file. ``width``: bits of an id, 16 or 32. Other columns are not read.

    Rows are dealt by ranges, so the text is shuffled once; a task holds one slice of it.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "records")
    narrow = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), "tie"]
    dealt = narrow.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    manifest = written(
        dealt.drop("tie").mapInArrow(
            lambda batches: _written(batches, folder, path, end, width), MANIFEST
        ),
        "manifest",
    )
    # One row for each file: a single task adds up few numbers, however large the files.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _payloads(fs, path: str, index: np.ndarray, chosen: np.ndarray, size: int):
    """Payloads of the records ``chosen``, in this order; runs of neighbours in one read."""
    ends = np.append(index["offset"][1:], size).astype(np.int64)
    starts = index["offset"].astype(np.int64)
    with fs.open_input_file(path) as f:
        k = 0
        while k < len(chosen):
            stop = k + 1
            while (
                stop < len(chosen)
                and chosen[stop] == chosen[stop - 1] + 1
                and ends[chosen[stop]] - starts[chosen[k]] <= READ_BYTES
            ):
                stop += 1
            low = int(starts[chosen[k]])
            data, at = f.read_at(int(ends[chosen[stop - 1]]) - low, low), 0
            for _ in range(k, stop):
                payload, at = unframed(data, at)
                yield payload
            k = stop


def _read(batches, width: int, seed: int | None, digest: bool) -> Iterator[pa.RecordBatch]:
    dtype = _dtype(width)
    for batch in batches:
        for row in batch.to_pylist():
            fs, path = FileSystem.from_uri(row["path"])
            index_fs, index_path = FileSystem.from_uri(row["index"])
            with index_fs.open_input_file(index_path) as f:
                index = np.frombuffer(f.read(), INDEX)
            before = np.cumsum(index["n_ids"].astype(np.int64)) - index["n_ids"].astype(np.int64)
            chosen = np.arange(len(index))
            if seed is not None:
                chosen = np.random.default_rng([seed, row["part"]]).permutation(len(index))
            out: list[list] = [[], [], [], []]
            size, held = fs.get_file_info(path).size, 0
            for k, payload in zip(chosen, _payloads(fs, path, index, chosen, size), strict=True):
                ids = np.frombuffer(payload, dtype, offset=HEAD)
                if len(ids) != index["n_ids"][k]:
                    raise ValueError(f"record {k} of {path} is not what its index says")
                known = int.from_bytes(payload[1:HEAD], "little", signed=True) if payload[0] else None
                wide = ids.astype("<u4")
                last = zlib.crc32(wide.tobytes()) if digest else wide.astype(np.int32)
                for column, v in zip(out, (known, row["first_id"] + int(before[k]), len(ids), last), strict=True):
                    column.append(v)
                held += len(payload)
                if held > READ_BYTES:
                    yield _batch(out, digest)
                    out, held = [[], [], [], []], 0
            yield _batch(out, digest)


def _batch(columns: list[list], digest: bool) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.int64() if digest else pa.list_(pa.int32())]
    names = ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
    )


def read_records(
    manifest: DataFrame, width: int = 16, seed: int | None = None, digest: bool = False
) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of each record, read from the manifest's files.

    ``start`` is the number of ids in all records before. With ``seed``, the files are read
    in an order drawn from it, by the index. With ``digest``, ``ids_crc32`` (of the ids as
    little-endian unsigned 32-bit numbers) takes the place of ``ids``. A damaged file fails.
    """
    schema = "doc_id bigint, start bigint, n_tokens bigint, " + (
        "ids_crc32 bigint" if digest else "ids array<int>"
    )
    files = max(1, manifest.count())
    return manifest.repartition(files).mapInArrow(
        lambda batches: _read(batches, width, seed, digest), schema
    )
