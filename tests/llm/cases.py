"""Rows that every operator on documents has to take."""

from pyspark.sql import functions as F

#: Names that operators use inside; a table may have columns of these names, too.
CLASHES = (
    "ids doc tie h hash spans terms carried row row_key known entity text_hash set_key bands "
    "sketch grp block piece minor kept component_id file path place ordinal start n_tokens "
    "part words label_pred score node component a b"
).split()

LONG = ("alpha beta gamma delta 12345 " * 4000).strip()

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog, said nobody."),
    (1, "The quick brown fox jumps over the lazy dog, said nobody."),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, LONG),
    (6, "a"),
    (None, "The quick brown fox jumps over the lazy dog, said nobody."),
    (None, None),
    (7, "Ünïcödé 日本語 🙂 words\nwith lines\nwith lines\n<|endoftext|> end"),
]


def odd_docs(spark, rows=None, parts=2):
    """``ROWS`` with the other columns of documents, all null, and clashing columns."""
    frame = spark.createDataFrame(ROWS if rows is None else rows, "doc_id bigint, text string")
    others = {c: F.lit(None).cast("string") for c in ("lang", "source")}
    others |= {c: F.lit("x") for c in CLASHES}
    return frame.withColumns(others | {"n_chars": F.length("text").cast("bigint")}).repartition(parts)


def empty_docs(spark):
    return odd_docs(spark, [])


def collected(frame):
    return [tuple(r) for r in frame.collect()]
