import hashlib
import random
import re

import pytest
from cases import LONG, ROWS, collected, empty_docs, odd_docs
from pyspark.sql import functions as F

from millrace.llm.fill_in_middle import (
    SCRATCH,
    Sentinels,
    fill_in_middle,
    line_ends,
    rearranged,
    restored,
    rotate,
    with_restored,
)


def brute_force(doc, text, percent=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    said = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(said[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return n, "plain", text, None, None
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if h[3] % 100 < spm:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def texts(n, seed=0):
    draw = random.Random(seed)
    pieces = ["\n", "\n\n", "a", "é", "日本", "🙂", "<", ">", "<P", "S>", "M", "\r\n", " ", "\x00", " "]
    return ["".join(draw.choices(pieces, k=draw.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("size", [0, 1, 2, 3, 10, 2 * SCRATCH + 7])
def test_blocks_change_places(size):
    data = random.Random(size).randbytes(size)
    for low, cut, high in ((0, size // 3, size), (0, 0, size), (0, size, size), (size // 4, size // 2, size - size // 5)):
        buffer = bytearray(data)
        rotate(buffer, low, cut, high)
        assert buffer == data[:low] + data[cut:high] + data[low:cut] + data[high:]
        rotate(buffer, low, low + high - cut, high)
        assert buffer == data


def test_lines():
    for text in [*texts(300), "", "a", "\n", "a\n", "a\nb"]:
        raw = text.encode()
        ends = line_ends(raw).tolist()
        assert [raw[a:b].decode() for a, b in zip(ends, ends[1:])] == re.findall(r"[^\n]*\n|[^\n]+", text)


def test_outputs_against_brute_force_and_back():
    forms = set()
    for k, text in enumerate([*texts(1500), "x <P> y", "<M>", "<<P>>", LONG]):
        for options in ({}, {"percent": 40, "spm_percent": 10, "seed": 3}):
            n, form, output, prefix, middle = rearranged(text, k, **options)
            told = brute_force(k, text, options.get("percent", 100), options.get("spm_percent", 50), options.get("seed", 7))
            assert (n, form, output.decode(), prefix, middle) == told
            assert restored(output, form) == text.encode()
            forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_what_is_not_of_its_form_fails():
    for form, output in (("psm", b"<S>a<P>b<M>c"), ("spm", b"<P>a<S>b<M>c"), ("psm", b"a"), ("other", b""), ("spm", b"x<S>a<P>b<M>c")):
        with pytest.raises(ValueError, match="not an output"):
            restored(output, form)


def test_sentinels_that_could_be_mistaken_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P>", "x<P>", "<M>"), ("ab", "bc", "<M>"), ("aba", "<S>", "<M>")):
        with pytest.raises(ValueError, match="sentinel"):
            Sentinels(*marks)
    marks = Sentinels("⟨pre⟩", "⟨suf⟩", "⟨mid⟩")
    for k, text in enumerate(texts(200, 1)):
        _, form, output, *_ = rearranged(text, k, marks)
        assert restored(output, form, marks) == text.encode()


def test_rows_of_all_kinds(spark):
    made = fill_in_middle(odd_docs(spark))
    assert made.dtypes == [
        ("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("output", "string"),
        ("prefix_chars", "bigint"), ("middle_chars", "bigint"),
    ]
    assert sorted(collected(made), key=str) == sorted(((k, *brute_force(k, t)) for k, t in ROWS), key=str)
    back = with_restored(made.withColumn("text", F.lit("clash")))
    assert back.columns == [*made.columns, "text", "restored"]
    assert sorted(((r.doc_id, r.restored) for r in back.collect()), key=str) == sorted(((k, t or "") for k, t in ROWS), key=str)
    assert collected(with_restored(fill_in_middle(empty_docs(spark)))) == []
    none = spark.createDataFrame([(None, "x"), ("psm", None)], "form string, output string")
    assert [r.restored for r in with_restored(none).collect()] == [None, None]
