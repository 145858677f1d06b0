import itertools
import zlib

import numpy as np
import pyarrow as pa
from cases import ROWS, collected, empty_docs, odd_docs
from pyspark.sql import functions as F

from millrace.llm.decontaminate import PlainWords
from millrace.llm.language import (
    fit,
    forward_backward,
    identify,
    label_words,
    train,
    word_probabilities,
)
from millrace.llm.queries import QUERIES
from millrace.sources import read_table

SF_DIR = "/root/testdata/sf0.01"

ENGLISH = "the cat and the dog went out of the house with their things and nothing was wrong"
GERMAN = "der hund und die katze gingen aus dem haus mit ihren sachen und nichts war falsch"


def test_forward_and_backward_against_all_labellings():
    draw = np.random.default_rng(0)
    scores, step = draw.normal(size=(3, 5, 3)), draw.normal(size=(3, 3))
    size = np.array([5, 3, 1])
    got, pairs = forward_backward(scores, size, step)
    expected_pairs = np.zeros((3, 3))
    for s, n in enumerate(size.tolist()):
        total, marginals = 0.0, np.zeros((n, 3))
        weighed = []
        for labels in itertools.product(range(3), repeat=n):
            w = sum(scores[s, t, k] for t, k in enumerate(labels))
            w = np.exp(w + sum(step[a, b] for a, b in itertools.pairwise(labels)))
            weighed.append((labels, w))
            total += w
        for labels, w in weighed:
            marginals[range(n), labels] += w / total
            for a, b in itertools.pairwise(labels):
                expected_pairs[a, b] += w / total
        assert np.allclose(got[s, :n], marginals)
    assert np.allclose(pairs, expected_pairs)


def small_model():
    texts = [" ".join(np.random.default_rng(k).permutation(t.split())) for k in range(30) for t in (ENGLISH, GERMAN)]
    return fit(texts, ["en", "de"] * 30)


def test_words_of_code_switched_text():
    model = small_model()
    assert model.languages == ["de", "en"]
    assert np.diag(model.transitions).min() > model.transitions[0, 1]  # neighbours agree
    words = PlainWords(pa.array([ENGLISH + " " + GERMAN]))
    best = word_probabilities(model, words).argmax(axis=1)
    n = len(ENGLISH.split())
    assert (best[:n] == 1).mean() > 0.9 and (best[n:] == 0).mean() > 0.9


def test_a_text_of_any_length_is_all_looked_at(spark):
    model = small_model()
    rows = [(1, ENGLISH + (" " + GERMAN) * 500), (2, GERMAN + (" " + ENGLISH) * 500)]
    got = {r[0]: r[1:] for r in collected(identify(odd_docs(spark, rows), model))}
    assert (got[1][0], got[2][0]) == ("de", "en") and all(0.9 < v[1] <= 1 for v in got.values())


def test_rows_of_all_kinds(spark):
    model = small_model()
    rows = [*ROWS, (8, "12 34 !"), (9, "٣ ½ 🙂"), (10, "Ж")]
    got = collected(identify(odd_docs(spark, rows), model))
    assert len(got) == len(rows)
    told = {r[0]: r[1:] for r in got if r[0] is not None}
    assert all(told[k] == ("und", 0.0) for k in (2, 3, 4, 8, 9))
    assert all(told[k][0] in ("de", "en") and 0 <= told[k][1] <= 1 for k in (1, 5, 6, 7, 10))
    assert collected(identify(empty_docs(spark), model)) == []
    labelled = {r.doc_id: r.words for r in label_words(odd_docs(spark, rows), model).collect()}
    assert [w.word for w in labelled[1]][:3] == ["the", "quick", "brown"] and labelled[3] == []


def test_nothing_to_learn_from(spark):
    model = train(odd_docs(spark))  # all labels are null
    assert model.languages == []
    assert {r[1:] for r in collected(identify(odd_docs(spark), model))} == {("und", 0.0)}
    assert {w.lang for r in label_words(odd_docs(spark), model).collect() for w in r.words} == {"und"}
    one = odd_docs(spark).withColumn("lang", F.lit("xx"))
    told = {r[0]: r[1] for r in collected(identify(one, train(one)))}
    assert told[5] == "xx" and told[3] == "und"


def test_held_out_accuracy(spark):
    docs = read_table(spark, SF_DIR, "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    frame = QUERIES["op4_language"](spark, SF_DIR)
    assert frame.dtypes == [
        ("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double"),
    ]
    rows = frame.collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert np.mean(held) > 0.98 and len(held) > 200


def test_held_out_labels_and_other_columns_are_not_looked_at(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    crc = F.crc32(F.col("doc_id").cast("string")) % 3
    other = docs.withColumn("lang", F.when(crc == 1, F.lit("zz")).otherwise(F.col("lang")))
    models = [train(d, rounds=3) for d in (docs, other.withColumn("source", F.lit("s")))]
    assert models[0].languages == models[1].languages
    assert (models[0].weights == models[1].weights).all()


def labelled(spark, rows, parts):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(parts)


def test_the_model_does_not_follow_how_rows_are_dealt(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    one, other = (train(d, texts_per_language=20, rounds=2) for d in (docs.repartition(7), docs.orderBy(F.desc("doc_id"))))
    assert one.languages == other.languages and (one.weights == other.weights).all()
    assert (one.transitions == other.transitions).all()


def test_no_language_is_lost(spark):
    """One with long texts alone, one with a single row among many."""
    rows = [(k, f"{ENGLISH} {k}", "en") for k in range(2000)]
    rows += [(5000 + k, GERMAN * 200, "de") for k in range(40)]
    rows += [(9000 + k, "zzz qqq xxx " * 9, "xx") for k in range(3)]
    assert len(GERMAN * 200) > 1 << 13
    model = train(labelled(spark, rows, 5), texts_per_language=10, longest_text=1 << 13, rounds=10)
    assert model.languages == ["de", "en", "xx"]
    got = identify(labelled(spark, [(1, GERMAN, None), (2, ENGLISH, None), (3, "zzz xxx qqq zzz", None)], 1), model)
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "de", 2: "en", 3: "xx"}


def test_a_letter_of_any_kind_has_a_language(spark):
    letters = ["µ", "ª", "º", "ⁿ", "5 µ", "1ª", "Ж", "中"]
    others = ["5", "½ €", "٣", "🙂", "—", "́"]
    got = identify(odd_docs(spark, list(enumerate(letters + others))), small_model())
    told = {r.doc_id: (r.lang_pred, r.score) for r in got.collect()}
    assert all(told[k][0] in ("de", "en") for k in range(len(letters)))
    assert all(told[k] == ("und", 0.0) for k in range(len(letters), len(told)))
