import hashlib
import math
import random
import re

import pytest
from cases import LONG, ROWS, collected, empty_docs, odd_docs
from pyspark.sql import functions as F

from millrace.llm.pii import _found, disclosing_terms, find_personal_data, near_terms, sanitise
from millrace.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": lambda: True,
        "ip": lambda: all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in match.split(".")),
        "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 8 <= len(digits) <= 15,
    }[kind]()


def brute_force(text):
    counts, spans = [], []
    for kind, pattern in PATTERNS.items():
        found = [m for m in re.finditer(pattern, text or "") if holds(kind, m[0])]
        counts.append(len(found))
        spans += [f"{kind}:{m.start()}:{m.end()}" for m in found]
    told = ",".join(spans)
    return (*counts, hashlib.sha256(told.encode()).hexdigest()), told


TEXTS = [
    "a@b.c_d@e.f x@y z@q.com. +1 (23) 456-7890 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111",
    "4111-1111-1111-1111 4111-1111-1111-1112 +12345678 +1234567890123456 0.0.0.0 256.1.1.1.1.1.1",
    "@a.b a@@b.c a@b..c 000255.1.1.1 1.1.1.1",
    "é@x.y 🙂 4111111111111111 é🙂 +49 (0) 30 123456 a.b@c.de",
    "+1 (212) 555-0100-4111111111111111",
    "mail x@y.zz, x@y.zz; 10.0.0.1.",
]
#: Where an expression that gives back or starts again would never end, or overflow.
HARD = ["1" * 30000, "1 " * 20000, "a." * 20000 + "@b.c", "+1" + " " * 20000, ".".join(["1"] * 9000), "x@y.z " * 2000]


def drawn(n):
    draw = random.Random(2)
    return ["".join(draw.choices("a1@.+- ()9é0", k=draw.randint(0, 80))) for _ in range(n)]


def test_values_of_any_texts(spark):
    texts = [*TEXTS, *drawn(600), *HARD[4:], "", None]
    frame = find_personal_data(odd_docs(spark, list(enumerate(texts))))
    assert frame.columns == "doc_id n_email n_ip n_card n_phone base_sha256 spans".split()
    for doc, *rest, spans in collected(frame):
        counts, told = brute_force(texts[doc])
        assert tuple(rest) == counts, texts[doc]
        assert spans == told  # and no terms: nothing of it is near in two texts


def test_long_runs_end(spark):
    got = {r.doc_id: r for r in find_personal_data(odd_docs(spark, list(enumerate(HARD)))).collect()}
    assert [got[k].n_email for k in range(6)] == [0, 0, 1, 0, 0, 2000]
    assert got[2].spans == "email:0:40004" and got[4].n_ip == 9000 // 4


def test_rows_of_all_kinds(spark):
    got = sorted(collected(find_personal_data(odd_docs(spark))), key=str)
    none = hashlib.sha256(b"").hexdigest()
    assert got == sorted(((k, 0, 0, 0, 0, none, "") for k, _ in ROWS), key=str)
    assert collected(find_personal_data(empty_docs(spark))) == []
    same = sanitise(odd_docs(spark))
    assert same.columns == odd_docs(spark).columns
    key = lambda rows: sorted(map(str, rows))
    assert key(collected(same)) == key(collected(odd_docs(spark)))
    assert collected(sanitise(empty_docs(spark))) == []


CORPUS = [
    (1, "Ask the gardener Quillfeather at q@x.org about roses."),
    (2, "Mail q@x.org for Quillfeather, who keeps roses."),
    (3, "The gardener grows roses and tulips."),
    (4, "Roses are red, nothing more."),
    (5, "More roses at the market, says nobody."),
    (6, "Quillfeather once more, with Q@X.org and roses. QUILLFEATHER!"),
    (7, "A lone Marigold writes from m@y.org today."),
    (8, "Nothing here."),
]


def information(term, entity="q@x.org", near=100):
    """n(t, e), n(t) and PMI / IC as the definition has them, for these short texts."""
    words = lambda t: set(re.findall(r"[^\W\d_]{4,}", t.lower()))
    holders = [t for _, t in CORPUS if entity in t.lower()]
    n_te = sum(term in words(t) for t in holders)
    n_t = sum(term in words(t) for _, t in CORPUS)
    ic = math.log2(len(CORPUS) / len(holders))
    return n_te, n_t, math.log2(n_te * len(CORPUS) / (n_t * len(holders))) / ic


@pytest.fixture
def corpus(spark):
    return odd_docs(spark, CORPUS, 3)


def test_terms_that_reveal_an_entity_are_found(spark, corpus):
    found = _found(corpus, "text", F.struct(F.col("doc_id").alias("id")), False, "found")
    found = found.withColumn("row_key", F.col("carried.id").cast("string"))
    pairs = near_terms(found, 100)
    told = disclosing_terms(corpus, found, pairs, "text", 2, -9.0).collect()
    told = {(r.entity, r.term): r.disclosure for r in told}
    assert set(told) == {("email:q@x.org", t) for t in ("quillfeather", "roses")}
    for (_, term), value in told.items():
        assert value == pytest.approx(information(term)[2])
    assert information("quillfeather")[2] == pytest.approx(1) and information("roses")[2] < 0.5


def test_terms_are_spans_of_their_documents_only(corpus):
    rows = {r.doc_id: r for r in find_personal_data(corpus).collect()}
    texts = dict(CORPUS)
    for k in (1, 2, 6):
        cut = [(p.split(":")[0], *map(int, p.split(":")[1:])) for p in rows[k].spans.split(",")]
        told = {(kind, texts[k][a:b].lower()) for kind, a, b in cut}
        assert told == {("email", "q@x.org"), ("term", "quillfeather")}
        assert rows[k].base_sha256 == brute_force(texts[k])[0][-1]
    assert rows[6].spans.count("term") == 2
    assert rows[7].spans == "email:28:35"  # seen with one text only
    assert rows[3].spans == rows[8].spans == ""


def test_repeated_rows_count_as_documents_but_not_as_texts(spark):
    twice = [(1, "Write to Hapaxword at h@x.org."), (1, "Write to Hapaxword at h@x.org."), (2, "x"), (3, "y")]
    rows = find_personal_data(odd_docs(spark, twice)).collect()
    assert len(rows) == 4 and not any("term" in r.spans for r in rows)
    more = [*twice, (4, "Hapaxword is h@x.org.")]
    rows = find_personal_data(odd_docs(spark, more)).collect()
    assert sum("term" in r.spans for r in rows) == 3


def test_terms_far_from_their_value_are_found_and_counted(spark):
    far = "Quillfeather. " + "Far away. " * 300 + "q@x.org"
    near = "Quillfeather has q@x.org now."
    rows = [(1, far), (2, far + "!"), (3, near), (4, near + "!"), *((k, f"away {k}") for k in range(5, 17))]
    spans = {r.doc_id: r.spans for r in find_personal_data(odd_docs(spark, rows)).collect()}
    assert all("term:0:12" in spans[k].split(",") for k in (1, 2, 3, 4))
    clean = {r.doc_id: r.text for r in sanitise(odd_docs(spark, rows)).collect()}
    assert not any("Quillfeather" in clean[k] for k in (1, 2, 3, 4))
    assert clean[1].count("Far away. ") == 300 and clean[5] == "away 5"
    # Counted near alone, the term is in half of the value's documents: 1 - log2(4 / 2) / 2.
    found = _found(odd_docs(spark, rows), "text", F.struct(F.col("doc_id").alias("id")), False, "found")
    found = found.withColumn("row_key", F.col("carried.id").cast("string"))
    told = disclosing_terms(odd_docs(spark, rows), found, near_terms(found, 100), "text", 2, -9.0).collect()
    assert {r.term: r.disclosure for r in told}["quillfeather"] == pytest.approx(1)


def test_sanitised_texts(corpus):
    clean = {r.doc_id: r.text for r in sanitise(corpus).collect()}
    assert clean[1] == "Ask the gardener  at [EMAIL] about roses."
    assert clean[6] == " once more, with [EMAIL] and roses. !"
    assert clean[3] == dict(CORPUS)[3] and clean[7] == "A lone Marigold writes from [EMAIL] today."
    soft = {r.doc_id: r.text for r in sanitise(corpus, remove=2.0).collect()}
    assert soft[2] == "Mail [EMAIL] for [TERM], who keeps roses."


def test_values_that_overlap_become_one(spark):
    text = "call +1 (212) 555-0100-4111 now 10.0.0.1, 4111 1111 1111 1111 x@10.0.0.1"
    got = sanitise(odd_docs(spark, [(1, text), (2, LONG + " 10.0.0.1")])).collect()
    clean = {r.doc_id: r.text for r in got}
    assert not re.search(r"10\.0|4111|x@", clean[1]) and clean[1].startswith("call ")
    assert clean[2] == LONG + " [IP]"


def test_nothing_runs_in_python(spark, capsys):
    QUERIES["op10_personal_data"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def rich(n, end):
    """A text of ``n`` different addresses, each with a name of its own."""
    letters = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(3))
    return " ".join(f"Name{letters(k)} wrote from user{k}@mail{k % 97}.org today{end}" for k in range(n))


def test_texts_of_many_different_values(spark):
    rows = [(1, rich(4000, "")), (2, rich(4000, " now")), (3, "clean"), (4, "more")]
    got = {r.doc_id: r for r in find_personal_data(odd_docs(spark, rows)).collect()}
    for k in (1, 2):
        spans = [p.split(":") for p in got[k].spans.split(",")]
        assert got[k].n_email == 4000 and got[k].base_sha256 == brute_force(rows[k - 1][1])[0][-1]
        terms = {rows[k - 1][1][int(a) : int(b)] for kind, a, b in spans if kind == "term"}
        assert {t for t in terms if t.startswith("Name")} == set(re.findall(r"Name\w+", rows[k - 1][1]))
    clean = {r.doc_id: r.text for r in sanitise(odd_docs(spark, rows)).collect()}
    assert clean[1].count("[EMAIL]") == 4000 and "@" not in clean[1] and "Name" not in clean[1]
    assert clean[3] == "clean"


def test_parts_of_a_text(spark):
    from millrace.llm.pii import CELL, _cells, _part, _running

    text = "".join(chr(97 + k % 26) for k in range(3 * CELL)) + "é🙂\n" * 200
    row = spark.createDataFrame([(text,)], "t string").withColumn("cells", _cells(F.col("t")))
    cuts = [(0, 0), (0, 1), (CELL, CELL), (CELL - 1, CELL + 1), (5, 3 * CELL + 9), (0, len(text)), (len(text) - 3, len(text) + 9)]
    got = row.select(*(_part(F.col("cells"), F.lit(a), F.lit(b)) for a, b in cuts)).first()
    assert list(got) == [text[a:b] for a, b in cuts]
    for n in (0, 1, 255, 256, 257, 1000):
        values = [(k * 7919) % 1000 for k in range(n)]
        frame = spark.createDataFrame([(values,)], "v array<int>")
        sums, most = frame.select(
            _running(F.col("v"), lambda a, b: a + b, F.lit(0)),
            _running(F.col("v"), lambda a, b: F.greatest(a, b), F.lit(0)),
        ).first()
        assert sums == [sum(values[:k]) for k in range(n + 1)]
        assert most == [max([0, *values[:k]]) for k in range(n + 1)]


def test_terms_of_the_whole_text_and_other_lengths(spark):
    far = "Xyz " + "far away " * 100 + "q@x.org"
    rows = [(1, far), (2, far + "!"), *((k, f"away {k}") for k in range(5, 17))]
    spans = {r.doc_id: r.spans for r in find_personal_data(odd_docs(spark, rows)).collect()}
    assert "term" not in spans[1]  # Xyz is far off, and short
    found = find_personal_data(odd_docs(spark, rows), near=None, letters=3)
    assert all("term:0:3" in r.spans.split(",") for r in found.collect() if r.doc_id in (1, 2))


def test_a_row_and_a_value_on_a_third_of_the_table(spark, monkeypatch):
    from millrace.llm import hot_keys

    monkeypatch.setattr(hot_keys, "SHARE", 8)
    rows = [(1, "Write to Hapaxword at h@x.org.")] * 200
    rows += [(k, f"Hapaxword again, h@x.org number {k}") for k in range(2, 100)]
    rows += [(k, "nothing") for k in range(1000, 1900)]
    got = find_personal_data(odd_docs(spark, rows, 5)).collect()
    assert len(got) == len(rows) and sum("term" in r.spans for r in got) == 298
    assert all(r.spans == "email:22:29,term:9:18" for r in got if r.doc_id == 1)


def pairs_by_brute_force(rows, support=2, generalise=0.8, letters=4):
    """Of each row, the words that disclose one of its values, by the definition on all pairs."""
    words = [set(re.findall(rf"[^\W\d_]{{{letters},}}", t.lower())) for _, t in rows]
    values = [{m[0].lower() for m in re.finditer(PATTERNS["email"], t)} for _, t in rows]
    told = set()
    for e in set().union(*values):
        holders = [k for k, v in enumerate(values) if e in v]
        ic = math.log2(len(rows) / len(holders))
        for t in set().union(*(words[k] for k in holders)):
            both = [k for k in holders if t in words[k]]
            n_t = sum(t in w for w in words)
            if len({rows[k][1] for k in both}) >= support and ic and 1 - math.log2(n_t / len(both)) / ic >= generalise:
                told.add((e, t))
    return [{t for e, t in told if e in v and t in w} for v, w in zip(values, words, strict=True)]


def test_no_pair_above_the_threshold_is_left_out(spark):
    far = "and so it goes on, " * 40
    rows = [(1, f"Quillfeather {far} q@x.org"), (2, f"q@x.org {far} Quillfeather"), (3, f"nothing {far}")]
    rows += [(k, f"number {k} {far}") for k in range(4, 20)]
    spans = {r.doc_id: r.spans for r in find_personal_data(odd_docs(spark, rows)).collect()}
    assert "term:0:12" in spans[1].split(",") and spans[2].endswith(f"term:{len(rows[1][1]) - 12}:{len(rows[1][1])}")
    assert spans[3] == spans[4] == ""


def test_no_pair_above_the_threshold_is_left_in_a_text(spark):
    far = "and so it goes on, " * 40
    rows = [(1, f"Quillfeather {far} q@x.org"), (2, f"q@x.org {far} Quillfeather"), (3, f"nothing {far}")]
    rows += [(k, f"number {k} {far}") for k in range(4, 20)]
    clean = {r.doc_id: r.text for r in sanitise(odd_docs(spark, rows)).collect()}
    assert clean[1] == f" {far} [EMAIL]" and clean[2] == f"[EMAIL] {far} " and clean[3] == rows[2][1]


@pytest.mark.parametrize("options", [{}, {"support": 1, "generalise": 0.3, "letters": 2}])
def test_words_of_random_rows_against_all_pairs(spark, options):
    draw = random.Random(7)
    name = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(2)) * 3
    rows = []
    for k in range(240):
        near = [name(int(draw.paretovariate(0.35)) % 600) for _ in range(draw.randint(0, 60))]
        mails = [f"{m}@{m}.org" for m in draw.sample(range(12), draw.choice((0, 0, 0, 1, 2)))]
        mails += ["77@77.org", "78@78.org"] * (k % 40 == 0)  # two values of the same rows
        near += [name(700 + int(m.split("@")[0])) for m in mails for _ in range(3) if draw.random() < 0.9]
        rows.append((k, " ".join(draw.sample(near + mails, len(near + mails)))))
    rows += rows[:20]
    told = pairs_by_brute_force(rows, **options)
    got = find_personal_data(odd_docs(spark, rows, 4), **options).collect()
    seen = sorted(
        (r.doc_id, sorted({t[int(a) : int(b)] for kind, a, b in (p.split(":") for p in r.spans.split(",") if p) if kind == "term"}))
        for r in got
        for t in [dict(rows)[r.doc_id]]
    )
    outside = lambda t: set(re.findall(r"[^\W\d_]+", re.sub(PATTERNS["email"], " ", t)))
    assert seen == sorted((k, sorted(w & outside(t))) for (k, t), w in zip(rows, told, strict=True))
    assert sum(map(bool, told)) > 5


def test_terms_in_capitals_that_lower_differently_in_a_text(spark):
    rows = [(1, "İskenderoğlu is q@x.org"), (2, "q@x.org, İSKENDEROĞLU"), (3, "ΟΔΟΣ'Α is at r@x.org"), (4, "r@x.org ΟΔΟΣ now")]
    rows += [(k, f"number {k}") for k in range(5, 30)]
    clean = {r.doc_id: r.text for r in sanitise(odd_docs(spark, rows)).collect()}
    assert clean[1] == " is [EMAIL]" and clean[2] == "[EMAIL], "
    assert clean[3] == "'Α is at [EMAIL]" and clean[4] == "[EMAIL]  now"


def test_pairs_that_just_meet_a_threshold(spark):
    # Of 49 documents 36 hold the value, 7 the term, 6 both: log2(7 / 6) is half of log2(49 / 36).
    rows = [(k, f"q@x.org {k}") for k in range(30)] + [(k, f"q@x.org Quillfeather {k}") for k in range(30, 36)]
    rows += [(36, "Quillfeather"), *((k, f"{k}") for k in range(37, 49))]
    docs = odd_docs(spark, rows)
    clean = {r.doc_id: r.text for r in sanitise(docs, generalise=0.5, remove=0.9).collect()}
    assert clean[30] == "[EMAIL] [TERM] 30" and clean[36] == "Quillfeather"
    clean = {r.doc_id: r.text for r in sanitise(docs, generalise=0.3, remove=0.5).collect()}
    assert clean[30] == "[EMAIL]  30" and clean[36] == "Quillfeather"
