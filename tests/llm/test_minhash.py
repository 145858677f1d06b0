import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import ROWS, collected, empty_docs, odd_docs

from millrace.llm.arrays import Words
from millrace.llm.components import components
from millrace.llm.minhash import near_duplicates, rows_per_band, shingles, signatures, without_near_duplicates


def shingle_set(text, size=5):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size)), strict=False))


def brute_force(rows, percent=85):
    """For each row: size of its set, smallest id reachable, kept."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    holders = defaultdict(set)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].add(k)
    for a, b in {p for g in holders.values() for p in itertools.combinations(sorted(g), 2)}:
        if rows[a][0] is None or rows[b][0] is None:
            continue
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            parent[root(a)] = root(b)
    smallest = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[root(k)] = min(doc, smallest.get(root(k), doc))
    out = []
    for k, (doc, _) in enumerate(rows):
        group = None if doc is None else smallest[root(k)]
        out.append((doc, len(sets[k]), group, doc is None or doc == group))
    return sorted(out, key=str)


def found(docs, **options):
    frame = near_duplicates(docs, **options).select("doc_id", "n_shingles", "component_id", "kept")
    assert frame.dtypes == [
        ("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean"),
    ]
    return sorted(collected(frame), key=str)


def planted(seed=0):
    """Texts with exact copies, chains of near ones and others just below the threshold."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=3))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(draw.choice([3, 5, 6, 40, 90, 200]))]
        for _ in range(draw.randint(1, 7)):
            text = base[:]
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3])):
                text[draw.randrange(len(text))] = word()
            if draw.random() < 0.3:
                base = text  # a chain
            rows.append((len(rows), draw.choice([" ", "  ", "\n"]).join(text).title()))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1024, 2])
def test_planted_copies_against_brute_force(spark, block):
    """With blocks of two classes, groups take many blocks and both rounds."""
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = brute_force(rows)
    assert found(docs, block_classes=block) == expected
    assert 10 < sum(not r[3] for r in expected) < len(rows) - 10


def test_rows_of_all_kinds(spark):
    assert found(odd_docs(spark)) == brute_force(ROWS)
    assert found(empty_docs(spark)) == []
    kept = sorted(collected(without_near_duplicates(odd_docs(spark)).select("doc_id", "text")), key=str)
    # Of the repeated row and its copy with a null id, one row stays.
    assert kept == sorted([ROWS[0], *(r for r in ROWS if r[1] != ROWS[0][1])], key=str)
    assert collected(without_near_duplicates(empty_docs(spark))) == []


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    base = " ".join(f"w{k}" for k in range(60))
    near = base.replace("w59", "end")
    rows = [(4, base), (4, base), (4, near), (None, near), (9, base), (None, "only a null id here"), (None, "only a null id here")]
    docs = odd_docs(spark, rows + [(1, ""), (1, ""), (None, None), (2, "x y")])
    got = without_near_duplicates(docs)
    assert got.dtypes == docs.dtypes
    kept = sorted(collected(got.select("doc_id", "text")), key=str)
    assert [r for r in kept if r[1] not in (base, near)] == sorted(
        [(1, ""), (1, ""), (2, "x y"), (None, None), (None, "only a null id here")], key=str
    )
    assert [r[0] for r in kept if r[1] in (base, near)] == [4]


def test_one_row_of_each_group_stays_with_all_its_columns(spark):
    rows = planted(1)
    docs = odd_docs(spark, rows)
    left = without_near_duplicates(docs, block_classes=3)
    assert left.columns == docs.columns
    gone = {r[0] for r in brute_force(rows) if not r[3]}
    assert sorted(r.doc_id for r in left.collect()) == sorted({r[0] for r in rows} - gone)


def test_repeated_ids_with_other_texts_are_other_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text), (1, "something else"), (2, text), (2, "and more")]
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute_force(rows)


def test_shingles_are_those_of_the_definition():
    texts = ["", None, "A b", "a B c d e f", "x " * 40, " ".join(map(str, range(50)))]
    sets, first = shingles(Words(pa.array(texts), lower=True))
    assert np.diff(first).tolist() == [len(shingle_set(t)) for t in texts]
    assert len(set(sets.tolist())) == len(set().union(*map(shingle_set, texts)))


def test_signatures_estimate_the_similarity():
    draw = np.random.default_rng(0)
    both, one, other = (draw.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    sets = np.concatenate((both, one, both, other))
    told = signatures(sets, np.array([0, 900, 1800]))
    assert abs((told[0] == told[1]).mean() - 0.8) < 0.12


def test_bands_all_but_never_miss_a_link():
    for percent in (80, 85, 90):
        r = rows_per_band(percent)
        assert (1 - (percent / 100) ** r) ** (126 // r) <= 1e-6


@pytest.mark.parametrize("seed", range(3))
def test_components_of_any_graph(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)]
    edges += [(k, k + 1) for k in range(100, 130)] + [(None, 1), (2, None), (5, 5)]
    parent = {k: k for e in edges if None not in e and e[0] != e[1] for k in e}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        if a in parent and b in parent and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = collected(components(spark.createDataFrame(edges, "a bigint, b bigint")))
    assert sorted(got) == sorted((k, root(k)) for k in parent)


def test_no_edges_no_components(spark):
    assert collected(components(spark.createDataFrame([], "a bigint, b bigint"))) == []


def templates(n, seed=0, own=40, shared=40):
    """Texts with half of their words in common; none is near another but the copies."""
    draw = random.Random(seed)
    common = [f"t{k}" for k in range(shared)]
    rows = [(k, " ".join(common + [f"{k}w{draw.randrange(10**6)}" for _ in range(own)])) for k in range(n)]
    for k in range(0, n, 10):
        words = rows[k][1].split()
        words[-1] = "changed"
        rows.append((n + k, " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [1024, 37])
def test_pages_of_one_template_are_not_linked(spark, block):
    rows = templates(300)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(docs, block_classes=block) == brute_force(rows)
    assert sum(not r[3] for r in brute_force(rows)) == 30


def test_links_that_a_buckets_smallest_does_not_show(spark):
    """Pairs are linked with each other, and not with the class that their bucket is named for."""
    draw = random.Random(4)
    rows = []
    for k in range(25):
        base = [f"s{x}" for x in range(60)] + [f"o{k}x{draw.randrange(10**6)}" for _ in range(25)]
        other = base[:-1] + [f"z{k}"]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = brute_force(rows)
    assert found(docs, block_classes=5) == found(docs) == expected
    assert len({r[2] for r in expected}) == 25


def test_a_row_on_most_of_the_table(spark, monkeypatch):
    from millrace.llm import hot_keys

    monkeypatch.setattr(hot_keys, "SHARE", 8)
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(5, base)] * 20_000 + [(7, base.replace("w59", "end")), (9, base.replace("w0", "begin"))]
    got = found(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6))
    assert len(got) == 20_002 and {r[2] for r in got} == {5} and sum(not r[3] for r in got) == 2


def test_texts_are_fetched_once_for_both_rounds(spark, monkeypatch, tmp_path):
    from millrace.llm import minhash

    path = str(tmp_path / "docs.parquet")
    rows = planted()
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
    steps = []

    def written(frame, name):
        steps.append((name, any(path in f for f in frame.inputFiles())))
        return keep(frame, name)

    keep = minhash.written
    monkeypatch.setattr(minhash, "written", written)
    assert found(spark.read.parquet(path), block_classes=2) == brute_force(rows)
    names = [name for name, _ in steps]
    assert "pieces" in names and "links" in names  # both rounds
    assert [name for name, reads in steps if reads] == ["described", "texts"]
