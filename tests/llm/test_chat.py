from collections import defaultdict

import pytest
from cases import collected
from oracle import run_sql

from millrace.llm.chat import perspectives
from millrace.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = "conv_id perspective seq turn speaker segment start end mask_start mask_end".split()


def brute_force(rows):
    first = lambda v: (v is not None, v)
    safe = lambda s: s.replace("<|", "< |")
    dialogues = defaultdict(list)
    for conv, *message in rows:
        dialogues[conv].append(message)
    out = []
    for conv, messages in dialogues.items():
        messages.sort(key=lambda m: tuple(map(first, m)))
        for who in {m[1] for m in messages} - {None, "system"}:
            at = 0
            for seq, (turn, speaker, text) in enumerate(messages):
                names = {who: "assistant", "system": "system", None: "user"}
                head = f"<|{names.get(speaker) or 'user name=' + safe(speaker)}|>\n"
                segment = head + safe(text or "") + "<|end|>\n"
                mask = (at + len(head), at + len(segment) - 1) if speaker == who else (None, None)
                out.append((conv, who, seq, turn, speaker, segment, at, at + len(segment), *mask))
                at += len(segment)
    return sorted(out, key=str)


ROWS = [
    (1, 0, "system", "Be kind."),
    (1, 1, "ann", "Hi <|assistant|> é🙂"),
    (1, 2, "bob", None),
    (1, 2, "bob", ""),
    (1, 2, "ann", "tie"),
    (1, 2, "ann", "tie"),
    (1, None, "cy<|", "no turn"),
    (1, 3, None, "who?"),
    (2, 0, "system", "nobody speaks"),
    (None, 0, "ann", "no id"),
    (None, 70, "bob", "later"),
    (3, -5, "ann", ""),
    *((4, k, ("ann", "bob", "cy")[k % 3], f"turn {k}") for k in range(200)),
]


@pytest.mark.parametrize("block", [1, 64])
def test_any_rows_against_brute_force(spark, block):
    frame = perspectives(spark.createDataFrame(ROWS, SCHEMA).repartition(5), block_turns=block)
    assert frame.columns == COLUMNS
    assert sorted(collected(frame), key=str) == brute_force(ROWS)


def test_segments_make_the_whole_dialogue(spark):
    frame = perspectives(spark.createDataFrame(ROWS, SCHEMA))
    for who in ("ann", "bob"):
        rows = frame.where(f"conv_id = 4 and perspective = '{who}'").orderBy("seq").collect()
        whole = "".join(r.segment for r in rows)
        assert len(rows) == 200 and all(whole[r.start : r.end] == r.segment for r in rows)
        masked = [whole[r.mask_start : r.mask_end] for r in rows if r.mask_start is not None]
        k = ("ann", "bob").index(who)
        assert masked == [f"turn {t}<|end|>" for t in range(200) if t % 3 == k]


def test_no_rows_and_clashing_columns(spark):
    assert collected(perspectives(spark.createDataFrame([], SCHEMA))) == []
    extra = spark.createDataFrame(
        [(*r, "x", "y", "z") for r in ROWS[:8]],
        SCHEMA + ", conv string, block string, perspective string",
    )
    assert sorted(collected(perspectives(extra)), key=str) == brute_force(ROWS[:8])


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_the_query_is_its_sql(spark, scale):
    sf_dir = f"/root/testdata/{scale}"
    frame = QUERIES["op5_chat"](spark, sf_dir)
    schema, expected = run_sql(sf_dir, ORACLE_SQL["op5_chat"])
    assert frame.columns == [c for c, _ in schema]
    assert sorted(collected(frame), key=str) == sorted(expected, key=str)


def test_nothing_runs_in_python(spark, capsys):
    QUERIES["op5_chat"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_messages_without_ids_or_turns_are_dealt_out(spark, conf):
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(None, None, ("ann", "bob")[k % 2], f"text {k % 40}") for k in range(600)]
    rows += [(None, 5, "cy", "the same")] * 300 + [(1, 2, "ann", "alone")]
    frame = perspectives(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert sorted(collected(frame), key=str) == brute_force(rows)
    blocks = spark.read.parquet(frame.inputFiles()[0].rsplit("/", 1)[0]).groupBy("conv", "block").count()
    assert blocks.agg({"count": "max"}).first()[0] < 400 and blocks.count() >= 5
