import random
import re

import numpy as np
import pyarrow as pa
from cases import LONG, ROWS, collected, empty_docs, odd_docs

from millrace.llm.quality import COUNTS, measures, passing, quality_rules, repeats


def longest_from(words):
    """For each word, the longest run from it that begins elsewhere, too."""
    out = [0] * len(words)
    for i in range(len(words)):
        for j in range(len(words)):
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def brute_force(text, min_words=10):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    repeated = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    runs = longest_from(words)
    covered = {k + d for k, n in enumerate(runs) if n >= min_words for d in range(n)}
    n = len(words)
    failed = n < 50 or 100 * len(repeated) > 50 * n
    kept = not failed and len(covered) <= 0.2 * n and max(runs, default=0) <= 100
    counts = (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated),
        len(covered), max(runs, default=0),
    )
    return (*counts, failed, kept)


def test_repeats_of_any_texts():
    draw = random.Random(3)
    for _ in range(300):
        texts = [
            [draw.randint(0, draw.choice([0, 1, 2, 6])) for _ in range(draw.randint(0, 25))]
            for _ in range(draw.randint(1, 5))
        ]
        flat = np.array([x for t in texts for x in t], np.int64)
        owner = np.array([k for k, t in enumerate(texts) for _ in t], np.int64)
        assert repeats(flat, owner).tolist() == [x for t in texts for x in longest_from(t)]


def made(seed):
    """Texts of few words, lines and passages that recur."""
    draw = random.Random(seed)
    out = []
    for _ in range(40):
        most, size, words = draw.choice([40, 5000]), draw.choice([0, 3, 49, 50, 120]), []
        word = lambda n=most: draw.choice(["", "é", "ab", "#x", "<b>", "cd*"]) + str(draw.randint(0, n))
        passage = [word() for _ in range(15)]
        while len(words) < size:
            words += draw.choice([[word()]] * 200 + [passage, ["same", "line", "here"]])
        out.append("".join(w + draw.choice([" ", " ", "\n", "\n\n", "\t ", "\r\n"]) for w in words))
    return out


def test_counts_and_verdicts_against_brute_force():
    texts = [t for s in range(4) for t in made(s)] + ["", None, " \n ", "x", "a\na\na", "a\n\na \na"]
    got = measures(pa.array(texts))
    rows = list(zip(*(got[c].tolist() for c in [*COUNTS, "base_failed", "kept"]), strict=True))
    assert rows == [brute_force(t) for t in texts]
    assert len({r[-1] for r in rows}) == 2


def test_rows_of_all_kinds(spark):
    frame = quality_rules(odd_docs(spark))
    assert frame.columns == ["doc_id", *COUNTS, "base_failed", "kept"]
    got = sorted(collected(frame), key=str)
    assert [r[0] for r in got] == sorted((k for k, _ in ROWS), key=str)
    long = next(r for r in got if r[0] == 5)
    n = len(LONG.split())
    assert long[1:8] == (n, len(LONG) - n + 1, 0, 0, n, n, n - 5) and long[8:] == (True, False)
    small = [(k, t) for k, t in ROWS if t != LONG]
    assert [r for r in got if r[0] != 5] == sorted(((k, *brute_force(t)) for k, t in small), key=str)
    assert collected(quality_rules(empty_docs(spark))) == []


def test_rows_that_pass_keep_their_columns(spark):
    rows = list(enumerate(t for s in range(2) for t in made(s)))
    docs = odd_docs(spark, rows)
    left = passing(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [k for k, t in rows if brute_force(t)[-1]]
    assert collected(passing(empty_docs(spark))) == []
