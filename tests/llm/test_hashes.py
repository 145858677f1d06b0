"""Pieces, words and lines of equal polynomial hashes are still told apart."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from millrace.llm import arrays, piece_cache
from millrace.llm.bpe import BytePairs, bpe_decode, bpe_digests, bpe_encode
from millrace.llm.library_bpe import library_cache
from millrace.llm.minhash import near_duplicates
from millrace.llm.piece_cache import PieceCache
from millrace.llm.quality import quality_rules
from millrace.llm.token_counts import document_token_counts
from millrace.llm.token_records import read_records, write_records

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: The two words of Thue and Morse: equal under every polynomial modulo 2**64.
BITS = [bin(k).count("1") % 2 for k in range(4096)]
ONE = "".join("ab"[b] for b in BITS)
OTHER = "".join("ba"[b] for b in BITS)


def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)


def test_spans():
    data = np.frombuffer((ONE + OTHER + ONE).encode(), np.uint8)
    at = np.arange(3) * 4096
    a, b, c = arrays.span_hashes(data, at, at + 4096).tolist()
    assert a == c != b
    assert len(set(arrays.span_hashes(data, np.array([0, 1, 1]), np.array([1, 1, 3])).tolist())) == 3


def test_sequences():
    words = arrays.mixed(np.array([1, 2, 3, 4, 5, 6, 7, 1, 2, 3, 4, 5, 6], np.uint64))
    for size in range(1, 8):
        got = arrays.sequence_hashes(words, size).tolist()
        spelled = [tuple(words[k : k + size].tolist()) for k in range(14 - size)]
        assert len(set(got)) == len(set(spelled)) == len(set(zip(got, spelled, strict=True)))
    assert not len(arrays.sequence_hashes(words, 14))


def test_ids(spark):
    encode = library()
    docs = docs_of(spark, ONE, OTHER, ONE + " " + OTHER)
    rows = {r.doc_id: r.ids for r in bpe_encode(docs, PATH).collect()}
    texts = {0: ONE, 1: OTHER, 2: ONE + " " + OTHER}
    assert rows == {k: encode(t) for k, t in texts.items()}
    back = {r.doc_id: r.text for r in bpe_decode(bpe_encode(docs, PATH), PATH).collect()}
    assert back == texts
    told = {r.doc_id: r.decoded_sha256 for r in bpe_digests(docs, PATH).collect()}
    assert told == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in texts.items()}
    counts = {r.doc_id: r.n_tokens for r in document_token_counts(docs, PATH, 50256).collect()}
    assert counts == {k: len(encode(t)) for k, t in texts.items()}
    records = {r.doc_id: list(r.ids) for r in read_records(write_records(docs, PATH, 2)).collect()}
    assert records == {k: [*encode(t), 2] for k, t in texts.items()}


def test_pieces_of_one_hash(monkeypatch):
    """Whatever the hash, a piece is compared with what the cache holds for it."""
    texts = ["one two three", "two  three one", "", "four one", "x"]
    encode = library()
    monkeypatch.setattr(piece_cache.Pretokens, "hashes", lambda self: np.zeros(len(self.starts), np.uint64))
    pairs = BytePairs(PATH)
    for cache in (PieceCache(pairs.pieces, {}), library_cache.__wrapped__(PATH)):
        for _ in range(2):
            ids, counts = cache.texts(texts)
            assert np.split(ids, np.cumsum(counts))[0].tolist() == encode(texts[0])
            assert ids.tolist() == [k for t in texts for k in encode(t)]


def test_many_slices_share_a_cache():
    encode, cache = library(), library_cache.__wrapped__(PATH)
    for k in range(300):
        text = f"piece{k} of{k % 7} {chr(0x4E00 + k)} " * 3
        assert cache.texts([text])[0].tolist() == encode(text)


def test_lines_and_sets(spark):
    filler = " ".join(f"w{k}" for k in range(60))
    got = quality_rules(docs_of(spark, f"{filler}\n{ONE}\n{OTHER}\n{ONE}")).first()
    assert got.n_dup_lines == 1
    assert quality_rules(docs_of(spark, f"{filler}\n{ONE}\n{OTHER}")).first().n_dup_lines == 0
    near = {r.doc_id: r.component_id for r in near_duplicates(docs_of(spark, ONE, OTHER, ONE)).collect()}
    assert near == {0: 0, 1: 1, 2: 0}


def test_words_next_to_each_other():
    words = arrays.Words(pa.array(["a b", "ab", "a  b\n", ""], pa.large_string()))
    a, b, ab, a2, b2 = words.hashes().tolist()
    assert (a, b) == (a2, b2) and len({a, b, ab}) == 3
