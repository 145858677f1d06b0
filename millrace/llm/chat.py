"""Chat formatting from each participant's point of view, in DataFrame operations alone.

For every participant of a dialogue the dialogue is rendered once, with that speaker as the
assistant and the others as named users. A rendering is kept as its segments, a row for each
message: joined in order of ``seq`` they are the whole text, and ``start`` and ``end`` place
them in it. So a dialogue of any length is many rows and never one.

Places are running sums. They are taken within blocks, then over the blocks' totals. Blocks
are ranges of turns, cut where a range of the sorted table ends: so also messages without an
id or turn, or many of one turn, are dealt out to several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.shared import written

SYSTEM = "system"
BLOCK_TURNS = 64

_END = "<|end|>"


def _safe(text: Column) -> Column:
    """``text`` without anything that would read as a marker."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def perspectives(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
    system: str = SYSTEM,
    block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """``conv_id, perspective, seq, turn, speaker, segment, start, end, mask_start, mask_end``.

    A row for each message and each participant of its dialogue; participants are its
    speakers but ``system`` and null. A message of ``perspective`` is the assistant's, and
    the mask covers its text and end marker; else ``mask_start`` and ``mask_end`` are null.
    Messages of ``system`` stay so, a null speaker is a user without a name. Places are
    characters of the rendered dialogue, the end exclusive; ``seq`` counts from 0.

    Messages are in order of turn, speaker, text, nulls first, so ties and repeated rows have
    an order; each is rendered. The sorted messages are written to the shared folder. ``<|`` in a text or name is written ``< |``. A null text is
    empty, null conversation ids are one dialogue. A dialogue without participants, and an
    empty table, give no rows. Turns are whole numbers.
    """
    turns = F.coalesce(F.floor(F.col("turn") / block_turns).cast("bigint"), F.lit(-(2**62)))
    # As a struct an id is never null, so null ones meet in joins as in groups.
    messages = conversations.select(
        F.struct(F.col(conv_col).alias("conv_id")).alias("conv"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.col(speaker_col).alias("speaker"),
        F.col(text_col).alias("raw"),
    ).withColumn("tie", F.monotonically_increasing_id())
    order = [F.col(c).asc_nulls_first() for c in ("turn", "speaker", "raw")]
    # Written, as the bounds of ranges are drawn anew by each run.
    messages = written(
        messages.repartitionByRange("conv", *order, "tie")
        .withColumn("block", F.struct(turns.alias("turns"), F.spark_partition_id().alias("part")))
        .drop("tie"),
        "messages",
    )
    participants = (
        messages.where(F.col("speaker").isNotNull() & (F.col("speaker") != system))
        .select("conv", F.col("speaker").alias("perspective"))
        .distinct()
    )
    per_block = messages.select("conv", "block").distinct().join(participants, "conv")

    text = _safe(F.coalesce("raw", F.lit("")))
    head = (
        F.when(F.col("speaker") == F.col("perspective"), F.lit("<|assistant|>\n"))
        .when(F.col("speaker") == system, F.lit("<|system|>\n"))
        .when(F.col("speaker").isNull(), F.lit("<|user|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), _safe(F.col("speaker")), F.lit("|>\n")))
    )
    rows = (
        messages.join(per_block, ["conv", "block"])
        .withColumn("head", head)
        .withColumn("segment", F.concat("head", text, F.lit(_END + "\n")))
        .withColumn("size", F.length("segment").cast("bigint"))
    )
    inside = Window.partitionBy("conv", "block", "perspective").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        (F.row_number().over(inside) - 1).cast("bigint").alias("seq_in"),
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start_in"),
    )
    totals = rows.groupBy("conv", "block", "perspective").agg(
        F.count("*").alias("n"), F.sum("size").alias("chars")
    )
    earlier = (
        Window.partitionBy("conv", "perspective")
        .orderBy("block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    base = totals.select(
        "conv",
        "block",
        "perspective",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("seq_0"),
        F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("start_0"),
    )
    own = F.col("speaker") == F.col("perspective")
    start = F.col("start_0") + F.col("start_in")
    return rows.join(base, ["conv", "block", "perspective"]).select(
        "conv.conv_id",
        "perspective",
        (F.col("seq_0") + F.col("seq_in")).alias("seq"),
        "turn",
        "speaker",
        "segment",
        start.alias("start"),
        (start + F.col("size")).alias("end"),
        F.when(own, start + F.length("head")).alias("mask_start"),
        F.when(own, start + F.col("size") - 1).alias("mask_end"),
    )


PERSPECTIVES_SQL = """
    WITH messages AS (
        SELECT conv_id, turn, role AS speaker, coalesce(text, '') AS t,
               row_number() OVER (
                   PARTITION BY conv_id
                   ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS seq
        FROM conversations
    ), participants AS (
        SELECT DISTINCT conv_id, speaker AS perspective FROM messages WHERE speaker <> 'system'
    ), rendered AS (
        SELECT m.conv_id, perspective, seq, turn, speaker,
               CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10)
                    WHEN speaker = 'system' THEN '<|system|>' || chr(10)
                    WHEN speaker IS NULL THEN '<|user|>' || chr(10)
                    ELSE '<|user name=' || replace(speaker, '<|', '< |') || '|>' || chr(10)
               END AS head,
               head || replace(t, '<|', '< |') || '<|end|>' || chr(10) AS segment
        FROM messages m JOIN participants p ON m.conv_id IS NOT DISTINCT FROM p.conv_id
    ), placed AS (
        SELECT *, CAST(sum(length(segment)) OVER (
                   PARTITION BY conv_id, perspective ORDER BY seq) AS BIGINT) AS stop
        FROM rendered
    )
    SELECT conv_id, perspective, seq, turn, speaker, segment,
           stop - length(segment) AS "start", stop AS "end",
           CASE WHEN speaker = perspective
                THEN stop - length(segment) + length(head) END AS mask_start,
           CASE WHEN speaker = perspective THEN stop - 1 END AS mask_end
    FROM placed
"""
