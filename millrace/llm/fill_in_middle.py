"""Fill-in-middle examples by rotating blocks of a text in place.

A text's bytes and three sentinels go into one buffer in the order prefix, middle, suffix,
each behind its sentinel. Exchanging two neighbouring blocks by three reversals (of each, and
of both together) gives either form, in the buffer itself and with a scratch of fixed size.
The same exchange, with the sizes in turn, takes a form back to the first order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.llm.arrays import slices

SEED = 7
PERCENT = 100  # of the texts that are rearranged
SPM_PERCENT = 50  # of these that begin with the suffix
SCRATCH = 1 << 16

PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        raw = self.raw
        whole = b"".join(raw)
        if not all(raw) or any(whole.count(x) != 1 for x in raw):
            raise ValueError("sentinels have to differ, and none may be part of another")
        for x in raw:
            for y in raw:
                if any(x.endswith(y[:k]) for k in range(1, len(y))):
                    # Else a text's end and a sentinel could make a sentinel sooner.
                    raise ValueError("no sentinel may end as a sentinel begins")

    @property
    def raw(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix.encode(), self.suffix.encode(), self.middle.encode()


def _reverse(view: np.ndarray, low: int, high: int) -> None:
    """Turn ``view[low:high]`` around, in place."""
    while high - low > 1:
        k = min(SCRATCH, (high - low) // 2)
        left = view[low : low + k].copy()
        view[low : low + k] = view[high - k : high][::-1]
        view[high - k : high] = left[::-1]
        low, high = low + k, high - k


def rotate(buffer: bytearray, low: int, cut: int, high: int) -> None:
    """Exchange the blocks ``buffer[low:cut]`` and ``buffer[cut:high]`` in place."""
    view = np.frombuffer(buffer, np.uint8)
    _reverse(view, low, cut)
    _reverse(view, cut, high)
    _reverse(view, low, high)


def line_ends(text: bytes) -> np.ndarray:
    """0 and the end of each line ``[^\\n]*\\n|[^\\n]+`` of ``text``."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x0A) + 1
    if len(text) and (not len(ends) or ends[-1] < len(text)):
        ends = np.append(ends, len(text))
    return np.concatenate(([0], ends))


def draws(doc_id: object, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that follow from the seed and the id."""
    said = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(said[k : k + 8], 16) for k in range(0, 32, 8))


def _points(text: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def rearranged(
    text: str,
    doc_id: object,
    marks: Sentinels = Sentinels(),
    seed: int = SEED,
    percent: int = PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> tuple[int, str, bytes, int | None, int | None]:
    """Number of lines, form, output, and code points of prefix and middle of a text."""
    raw = text.encode()
    ends = line_ends(raw)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not raw or any(m in raw for m in marks.raw) or h3 % 100 >= percent:
        return n, PLAIN, raw, None, None
    one, two = h1 % (n + 1), h2 % (n + 1)
    first, second = int(ends[min(one, two)]), int(ends[max(one, two)])
    prefix, suffix, middle = marks.raw
    buffer = bytearray(raw)
    buffer[second:second] = suffix
    buffer[first:first] = middle
    buffer[0:0] = prefix
    at_middle = len(prefix) + first
    at_suffix = len(prefix) + len(middle) + second
    form = SPM if h4 % 100 < spm_percent else PSM
    rotate(buffer, 0 if form == SPM else at_middle, at_suffix, len(buffer))
    return n, form, bytes(buffer), _points(raw[:first]), _points(raw[first:second])


def restored(output: bytes, form: str, marks: Sentinels = Sentinels()) -> bytes:
    """The text that ``output`` was made from; fails if it isn't of its form."""
    if form == PLAIN:
        return output
    prefix, suffix, middle = marks.raw
    at = {m: output.find(m) for m in marks.raw}
    order = {PSM: (prefix, suffix, middle), SPM: (suffix, prefix, middle)}.get(form, ())
    places = [at[m] for m in order]
    if not places or places[0] != 0 or -1 in places or places != sorted(places):
        raise ValueError(f"not an output of form {form}")
    buffer = bytearray(output)
    # Suffix and what follows it change places; then sentinels go, the last one first.
    low, cut = at[suffix], at[middle] if form == PSM else at[prefix]
    rotate(buffer, low, cut, len(buffer))
    for mark in (suffix, middle, prefix):
        k = buffer.find(mark)
        del buffer[k : k + len(mark)]
    return bytes(buffer)


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    marks: Sentinels = Sentinels(),
    seed: int = SEED,
    percent: int = PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """``doc_id, n, form, output, prefix_chars, middle_chars`` of each row's whole text.

    A text of n lines (a line has its newline) is cut after two numbers of lines that follow
    from ``seed`` and the id; what is before the smaller is the prefix, up to the larger the
    middle. ``form`` is ``psm`` (prefix, suffix, middle, each behind its sentinel), ``spm``
    (suffix, prefix, middle) for ``spm_percent`` of them, or ``plain``: the text itself, if
    it is empty, holds a sentinel, or isn't of the ``percent`` drawn. Sizes are in code
    points, and null for ``plain``.

    A null text is empty. A null id is drawn for as an empty string. Repeated rows give
    repeated rows, no rows none; other columns are not read, nothing is shuffled. Memory
    follows the longest text.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "form", "output", "prefix_chars", "middle_chars"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, texts = part["doc_id"].to_pylist(), part["text"].fill_null("").to_pylist()
                rows = [
                    rearranged(t, k, marks, seed, percent, spm_percent)
                    for k, t in zip(ids, texts, strict=True)
                ]
                n, form, output, prefix, middle = zip(*rows, strict=True)
                columns = [
                    part["doc_id"],
                    pa.array(n, pa.int64()),
                    pa.array(form, pa.string()),
                    pa.array(output, pa.binary()).cast(pa.string()),
                    pa.array(prefix, pa.int64()),
                    pa.array(middle, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return narrow.mapInArrow(
        run,
        f"doc_id {kind}, n bigint, form string, output string, prefix_chars bigint, middle_chars bigint",
    )


def with_restored(
    made: DataFrame,
    form_col: str = "form",
    output_col: str = "output",
    marks: Sentinels = Sentinels(),
    restored_col: str = "restored",
) -> DataFrame:
    """``made`` with the text that each output was made from, by its form alone.

    A null form or output gives a null; an output that isn't of its form fails.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, output_col):
                texts = [
                    None if f is None or o is None else restored(o.encode(), f, marks)
                    for f, o in zip(part[form_col].to_pylist(), part[output_col].to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.binary()).cast(pa.string())],
                    [*part.schema.names, restored_col],
                )

    schema = StructType([*made.schema.fields, StructField(restored_col, StringType())])
    return made.mapInArrow(run, schema)


FILL_IN_MIDDLE_SQL = r"""
    WITH texts AS (
        SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents
    ), units AS (
        SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u,
               CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
               CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
        FROM texts
    ), cuts AS (
        SELECT *, CAST(len(u) AS BIGINT) AS n,
               least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS i,
               greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS j,
               CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>')
                         OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                    WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
        FROM units
    ), parts AS (
        SELECT *, array_to_string(u[1:i], '') AS p, array_to_string(u[i + 1:j], '') AS m,
               array_to_string(u[j + 1:], '') AS s
        FROM cuts
    )
    SELECT doc_id, n, form,
           CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t
                            WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                            ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(CASE WHEN form = 'plain' THEN t ELSE p || m || s END) AS restored_sha256
    FROM parts
"""
