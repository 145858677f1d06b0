"""The library is the judge: ids and texts have to be those it gives."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from cases import LONG, ROWS, collected, empty_docs, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm.bpe import BytePairs, bpe_decode, bpe_digests, bpe_encode, byte_pairs
from millrace.llm.library_bpe import library_cache
from millrace.llm.pretokens import LETTER, NUMBER, OTHER, SPACE, Pretokens, classes

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)

TEXTS = [
    "",
    "it's 's don't 'sabc ''s 'll've  'x 'S I'M",
    "a  b\n\n c \n",
    " " * 300 + "x" + " " * 300,
    "<|endoftext|>a <|endoftext|><|endoftext|> <|endoftext",
    "x\x1cz\x85q r　s",
    "日本語テキスト 123٣٤ ½ x² 🙂🙃 👩‍👩‍👧",
    "a" * 1000,
    "-" * 500,
    "'",
    "'l",
    LONG,
    *(f"{a}{b}" for a in ("", " ", "\n", "x", "'") for b in ("'s", "'re", "'", "\n", " ")),
]


def library_ids(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def split(ids, counts):
    ends = np.cumsum(counts)
    return [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)]


@pytest.mark.parametrize("cache", [lambda: byte_pairs(PATH)[1], lambda: library_cache(PATH)])
def test_ids_are_the_librarys(cache):
    draw = random.Random(1)
    alphabet = "ab '’s tre\n\t .,!12é日 🙂vlmd<|>"
    texts = TEXTS + ["".join(draw.choices(alphabet, k=draw.randint(0, 60))) for _ in range(3000)]
    assert split(*cache().texts(texts)) == library_ids(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_any_texts(texts):
    pairs, cache = byte_pairs(PATH)
    ids, counts = cache.texts(texts)
    assert split(ids, counts) == library_ids(texts)
    assert pairs.decode(ids).decode() == "".join(texts)


def test_each_code_point_has_the_librarys_class():
    """Next to a letter, number or other sign, it is one piece with those of its class."""
    alike = {LETTER: "a", NUMBER: "1", OTHER: "!"}
    pieces = LIBRARY.pre_tokenizer.pre_tokenize_str
    table = classes()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    points = [*range(0x3100), *points[0x3100::61]]
    for c in points:
        kinds = [k for k, x in alike.items() if len(pieces(x + chr(c))) == 1] or [SPACE]
        assert table[c] == kinds[0], hex(c)


def test_compatible_is_what_merging_says():
    pairs, _ = byte_pairs(PATH)
    draw = np.random.default_rng(2)
    a, b = draw.integers(0, 50256, (2, 4000))
    told = pairs.compatible(a, b)
    for x, y, fits in zip(a.tolist(), b.tolist(), told.tolist(), strict=True):
        assert fits == (pairs.merged(pairs.text[x] + pairs.text[y]) == [x, y])
    assert 0 < told.sum() < len(told)


def test_all_tokens_are_made_from_their_own_bytes():
    pairs, _ = byte_pairs(PATH)
    assert all(pairs.merged(pairs.text[k]) == [k] for k in pairs.by_text.values() if k % 7 == 0)
    assert len(pairs.by_text) == 50256


def test_some_words_need_merging_and_some_do_not():
    pairs, _ = byte_pairs(PATH)
    words = [" theand", " eringhe", " the", " dog", " ontionous"]
    kinds = {pairs.greedy(w.encode()) == pairs.merged(w.encode()) for w in words}
    assert kinds == {True, False}


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="not a plain byte-level BPE"):
        BytePairs(public_tokenizers.path("word_bpe_49k.json"))


def test_pieces_of_texts_do_not_touch():
    both = Pretokens(["a", "b 'l", "l x"])
    assert [both.piece(k) for k in range(len(both.starts))] == ["a", "b", " '", "l", "l", " x"]


def test_a_cache_that_is_full_starts_over(monkeypatch):
    monkeypatch.setattr("millrace.llm.piece_cache.MOST_PIECES", 3)
    _, cache = byte_pairs(PATH)
    for text in ("one two three four five six", "seven eight nine", "one two ten"):
        assert split(*cache.texts([text])) == library_ids([text])


def test_rows_of_all_kinds(spark):
    texts = [t or "" for _, t in ROWS]
    expected = sorted(zip([r[0] for r in ROWS], library_ids(texts), strict=True), key=str)
    encoded = bpe_encode(odd_docs(spark), PATH)
    assert encoded.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert sorted(collected(encoded), key=str) == expected
    decoded = sorted(collected(bpe_decode(encoded, PATH)), key=str)
    assert decoded == sorted(((k, t or "") for k, t in ROWS), key=str)
    digests = sorted(collected(bpe_digests(odd_docs(spark), PATH)), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert digests == sorted(
        (
            (k, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False)))
            for (k, _), ids in zip(ROWS, library_ids(texts), strict=True)
        ),
        key=str,
    )
    assert collected(bpe_digests(empty_docs(spark), PATH)) == []
    assert collected(bpe_encode(empty_docs(spark), PATH)) == []


def test_null_ids_and_bytes_that_are_no_text(spark):
    frame = spark.createDataFrame([(1, None), (2, []), (3, [222, 50256])], "doc_id bigint, ids array<int>")
    assert sorted(collected(bpe_decode(frame, PATH))) == [
        (1, ""),
        (2, ""),
        (3, LIBRARY.decode([222, 50256], skip_special_tokens=False)),
    ]
