"""Language of words by a linear-chain conditional random field, and of texts by its words.

A word's features are its affixes and n-grams (of bytes, from its marked ends on, so that
n-grams at an end are affixes) and the word itself, the lexicon; they are hashed into a
table of weights for each language. Transition weights between the languages of neighbours
are learned with them. Forward and backward passes give each word's probability of each
language in its sequence; a text's is their mean.

Only texts are labelled, so training words take their text's language, and half of the
training sequences are joined from two languages, as code-switched text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.arrays import mixed, ranges, slices, sums
from millrace.llm.decontaminate import PlainWords

UNDETERMINED = "und"
TABLE_BITS = 18
LONGEST_GRAM = 4
SEQUENCE = 64  # words; longer texts are several sequences
TEXTS_PER_LANGUAGE = 150
MOST_LANGUAGES = 200
LONGEST_TEXT = 1 << 16  # characters of a text to learn from
ROUNDS = 25

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[ord("A") : ord("Z") + 1] = True


def features(words: PlainWords, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the weight table for each of the ``chosen`` words: flat, and their counts."""
    size = words.ends[chosen] - words.starts[chosen]
    # All words with a mark before and after each.
    wide = size + 2
    begin = np.cumsum(wide) - wide
    flat = np.full(int(wide.sum()), 0x20, np.uint64)
    flat[ranges(begin + 1, size)] = words.data[ranges(words.starts[chosen], size)]
    rows, owner = [mixed(words.hashes()[chosen])], [np.arange(len(chosen), dtype=np.int32)]
    for n in range(1, LONGEST_GRAM + 1):
        counts = np.maximum(0, wide - n + 1)
        at = ranges(begin, counts)
        value = np.full(len(at), n, np.uint64)
        for k in range(n):
            value = value * np.uint64(257) + flat[at + k]
        rows.append(mixed(value))
        owner.append(np.repeat(np.arange(len(chosen), dtype=np.int32), counts))
    all_rows, all_owners = np.concatenate(rows), np.concatenate(owner)
    order = np.argsort(all_owners, kind="stable")
    return (all_rows[order] >> np.uint64(64 - TABLE_BITS)).astype(np.int32), np.bincount(
        all_owners, minlength=len(chosen)
    )


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # feature row x language
    transitions: np.ndarray  # language before x language

    def scores(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The languages' scores of each word, from its features."""
        if not len(counts):
            return np.zeros((0, len(self.languages)))
        return np.add.reduceat(self.weights[rows], np.cumsum(counts) - counts, axis=0)


def forward_backward(scores: np.ndarray, size: np.ndarray, transitions: np.ndarray):
    """Probabilities of each word's labels, and expected counts of each pair of labels.

    ``scores``: sequence x place x label; ``size``: words of each sequence, at least one.
    """
    n, length, _ = scores.shape
    step = np.exp(transitions)
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    live = np.arange(length) < size[:, None]
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    scale = np.ones((n, length))
    alpha[:, 0] = emit[:, 0]
    scale[:, 0] = alpha[:, 0].sum(axis=1)
    alpha[:, 0] /= scale[:, :1]
    for t in range(1, length):
        alpha[:, t] = (alpha[:, t - 1] @ step) * emit[:, t]
        scale[:, t] = alpha[:, t].sum(axis=1)
        alpha[:, t] /= scale[:, t : t + 1]
    for t in range(length - 2, -1, -1):
        back = (emit[:, t + 1] * beta[:, t + 1]) @ step.T / scale[:, t + 1 : t + 2]
        beta[:, t] = np.where(live[:, t + 1 : t + 2], back, 1.0)
    marginals = alpha * beta
    marginals /= marginals.sum(axis=2, keepdims=True)
    pairs = np.zeros_like(step)
    for t in range(1, length):
        ahead = emit[:, t] * beta[:, t] / scale[:, t : t + 1] * live[:, t : t + 1]
        pairs += alpha[:, t - 1].T @ ahead
    return marginals, pairs * step


def _sequences(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequences of texts of ``counts`` words: text, first word in it, and size."""
    n = -(-counts // SEQUENCE)
    text = np.repeat(np.arange(len(counts)), n)
    begin = ranges(np.zeros(len(counts), np.int64), n) * SEQUENCE
    return text, begin, np.minimum(SEQUENCE, counts[text] - begin)


def word_probabilities(model: Model, words: PlainWords) -> np.ndarray:
    """Each word's probability of each language."""
    out = np.zeros((len(words.starts), len(model.languages)))
    if not len(out) or not model.languages:
        return out
    code, _ = pd.factorize(words.hashes())
    example = np.zeros(code.max() + 1, np.int64)
    example[code[::-1]] = np.arange(len(code))[::-1]
    scores = model.scores(*features(words, example))
    text, begin, size = _sequences(words.counts)
    first = words.first[text] + begin
    order = np.argsort(size)
    for some in np.array_split(order, max(1, len(order) // 4096)):
        if not len(some):
            continue
        length = int(size[some].max())
        at = np.minimum(first[some, None] + np.arange(length), len(code) - 1)
        got, _ = forward_backward(scores[code[at]], size[some], model.transitions)
        live = np.arange(length) < size[some, None]
        out[at[live]] = got[live]
    return out


def fit(texts: list[str], labels: list[str], rounds: int = ROUNDS, seed: int = 0) -> Model:
    """A model from whole texts and their languages, by adaptive gradient steps."""
    languages = sorted(set(labels))
    model = Model(
        languages,
        np.zeros((1 << TABLE_BITS, len(languages))),
        np.zeros((len(languages), len(languages))),
    )
    words = PlainWords(pa.array(texts, pa.large_string()))
    if len(languages) < 2 or not len(words.starts):
        return model
    code, _ = pd.factorize(words.hashes())
    example = np.zeros(code.max() + 1, np.int64)
    example[code[::-1]] = np.arange(len(code))[::-1]
    rows, counts = features(words, example)
    owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    label = np.searchsorted(languages, labels)[words.text]
    # Sequences of two halves: the second one is, for every other sequence, another text's.
    text, begin, size = _sequences(words.counts)
    first = words.first[text] + begin
    at = first[:, None] + np.arange(SEQUENCE)
    other = np.random.default_rng(seed).permutation(len(first))
    half = SEQUENCE // 2
    joined = (np.arange(len(first)) % 2 == 1) & (size == SEQUENCE) & (size[other] == SEQUENCE)
    at[joined, half:] = at[other[joined], half:]
    at = np.minimum(at, len(code) - 1)
    live = np.arange(SEQUENCE) < size[:, None]
    truth = label[at]
    seen = np.zeros_like(model.transitions)
    both = live[:, 1:]
    np.add.at(seen, (truth[:, :-1][both], truth[:, 1:][both]), 1)
    tokens, targets = code[at[live]], truth[live]
    n, k = len(counts), len(languages)
    observed = np.bincount(tokens * k + targets, minlength=n * k).reshape(n, k)
    squares, t_squares = np.full_like(model.weights, 1e-8), np.full_like(seen, 1e-8)
    total = len(tokens)
    for _ in range(rounds):
        scores = model.scores(rows, counts)
        got, pairs = forward_backward(scores[code[at]], size, model.transitions)
        expected = np.stack(
            [np.bincount(tokens, got[..., j][live], minlength=n) for j in range(k)], axis=1
        )
        gap = (observed - expected) / total
        for j in range(k):
            grad = np.bincount(rows, gap[owner, j], minlength=1 << TABLE_BITS)
            grad -= 1e-7 * model.weights[:, j]
            squares[:, j] += grad * grad
            model.weights[:, j] += 0.3 * grad / np.sqrt(squares[:, j])
        t_grad = (seen - pairs) / total
        t_squares += t_grad * t_grad
        model.transitions += 0.3 * t_grad / np.sqrt(t_squares)
    model.weights = model.weights.astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; not, where it is null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    texts_per_language: int = TEXTS_PER_LANGUAGE,
    most_languages: int = MOST_LANGUAGES,
    longest_text: int = LONGEST_TEXT,
    rounds: int = ROUNDS,
) -> Model:
    """A model from a sample of the labelled rows of ``docs`` that are not held out.

    The ``texts_per_language`` texts of each language with the smallest hashes of id and
    text are learned from, so the model is the same for the same rows however they are
    dealt. Texts of over ``longest_text`` characters are taken only where a language has too
    few others, and learned from so far. These bounds make the sample fit on the driver, as
    ``most_languages``, those with the most rows, does for the model: 2 MB each. Rows with a
    null id, text or language are not drawn.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).where("doc_id is not null and text is not null and lang is not null")
    rows = rows.where(~held_out(F.col("doc_id"))).withColumns(
        {"long": F.length("text") > longest_text, "h": F.xxhash64("doc_id", "text")}
    )
    counts = rows.groupBy("lang").agg(
        F.count("*").alias("n"), F.sum((~F.col("long")).cast("bigint")).alias("short")
    )
    known = counts.orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not known:
        return Model([], np.zeros((1 << TABLE_BITS, 0)), np.zeros((0, 0)))
    # Of many rows only some have a hash so small: enough of them, all but certainly. Long
    # texts are drawn from only if there are too few short ones for that.
    least, want = -(1 << 63), 2 * texts_per_language + 64

    def below(n: int) -> int:
        return least + min((1 << 64) - 1, (1 << 64) * want // max(1, n))

    bounds = docs.sparkSession.createDataFrame(
        [(r.lang, below(r.short), below(r.n - r.short) if r.short < want else least) for r in known],
        "lang string, of_short bigint, of_long bigint",
    )
    few = rows.join(F.broadcast(bounds), "lang").where(
        F.col("h") <= F.when(F.col("long"), F.col("of_long")).otherwise(F.col("of_short"))
    )
    first = Window.partitionBy("lang").orderBy("long", "h", "doc_id", "text")
    sample = few.withColumn("k", F.row_number().over(first)).where(F.col("k") <= texts_per_language)
    got = sorted(sample.select("lang", F.substring("text", 1, longest_text).alias("text")).collect())
    return fit([r.text for r in got], [r.lang for r in got], rounds)


def _has_letter(words: PlainWords, column: pa.Array) -> np.ndarray:
    """Whether each text has a letter, of any script."""
    plain = sums(_LETTER[words.data], words.offsets) > 0
    for k in np.flatnonzero(~plain & (np.diff(words.offsets) > 0)).tolist():
        plain[k] = any(map(str.isalpha, column[k].as_py()))
    return plain


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, lang_pred, score`` of each row: the language of its whole text.

    The score is the mean probability of the language over the text's words, 0 to 1; of
    languages that tie the first in order is taken, so also for a text whose letters are
    all signs (as ``µ``), with score 0. A text that is null or has no letter, and every text
    if the model knows no language, is ``und`` with score 0. Repeated rows
    give repeated rows. Nothing is shuffled; only the text is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of the fixed size of its table
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = np.array([*known.languages, UNDETERMINED], object)
        for batch in batches:
            for part in slices(batch, "text"):
                words = PlainWords(part["text"])
                told = _has_letter(words, part["text"]) & bool(known.languages)
                best = np.full(part.num_rows, len(known.languages))
                score = np.zeros(part.num_rows)
                if told.any():
                    each = word_probabilities(known, words)
                    mean = np.stack([_means(each[:, j], words) for j in range(each.shape[1])], axis=1)
                    best[told] = mean.argmax(axis=1)[told]
                    score[told] = np.clip(mean.max(axis=1)[told], 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(names[best], pa.string()), pa.array(score)],
                    ["doc_id", "lang_pred", "score"],
                )

    return narrow.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def _means(values: np.ndarray, words: PlainWords) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    return (total[words.first[1:]] - total[words.first[:-1]]) / np.maximum(1, words.counts)


def label_words(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, words``: each word of the row's text with its language and probability.

    Words are runs of letters and digits, lowered, in order. Null or empty texts have none;
    without a known language all words are ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                words = PlainWords(part["text"])
                each = word_probabilities(known, words)
                raw = words.data.tobytes()
                spelled = [raw[a:b].decode() for a, b in zip(words.starts, words.ends, strict=True)]
                if known.languages:
                    best = each.argmax(axis=1)
                    lang, p = [known.languages[k] for k in best], each.max(axis=1)
                else:
                    lang, p = [UNDETERMINED] * len(spelled), np.zeros(len(spelled))
                entries = pa.StructArray.from_arrays(
                    [pa.array(spelled, pa.string()), pa.array(lang, pa.string()), pa.array(p)],
                    ["word", "lang", "p"],
                )
                lists = pa.ListArray.from_arrays(pa.array(words.first, pa.int32()), entries)
                yield pa.RecordBatch.from_arrays([part["doc_id"], lists], ["doc_id", "words"])

    return narrow.mapInArrow(
        run, f"doc_id {kind}, words array<struct<word:string,lang:string,p:double>>"
    )
