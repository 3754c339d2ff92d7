"""Language identification by a linear-chain conditional random field.

Every word of a text gets a label. A word's emission score sums learned
weights of its features: character sequences of 1 to 4 characters of the word
between boundary marks (those that touch a mark are its affixes) and the whole word
(the lexicon). Learned transitions between neighbouring words' labels let
code-switched text change language at a cost. Forward-backward gives each
word's label probabilities; a text's language is the label with the highest
mean probability over its words, and the score is that mean.

Training reads a bounded sample (``per_language`` documents of each language,
lowest hash first, of at most ``train_chars`` characters): half the documents are
kept whole, the lines of the others are shuffled into code-switched sequences.
The gradient of the likelihood (forward-backward expectations) is followed by
Adam on the driver; the weights, ``2 ** HASH_BITS`` per language, are sent to the tasks.

Forward-backward over many texts is vectorised exactly: words stand in one
long row, cut into chunks whose transfer matrices are multiplied up, so a text
of any length is one chain.

Defined results: a null or empty text, or one without a letter, is ``und``
with score zero, as is every text when there is nothing to learn from; null
languages are not learned from; repeated rows are judged alike; ties go to the
language first in sorted order; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subrecon.llm.common import by_bytes, fold, mix64

HASH_BITS = 17
NGRAMS = (1, 2, 3, 4)
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
CHUNK = 128
_find = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> list[str]:
    """Lower-case words of a text, none if it has no letter."""
    words = _find(text.lower()) if text else []
    return words if any(any(map(str.isalpha, w)) for w in words) else []


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, word, value): hashed features of each word; a word's values have norm one."""
    padded = [f"^{w}$" for w in words]
    c = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    at = np.repeat(np.arange(len(words)), size)
    found = []
    h = np.zeros(len(c), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        m = max(0, len(c) - n + 1)
        h = mix64(h[:m] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1:n - 1 + m] + np.uint64(n))
        if n in NGRAMS:
            whole = at[:m] == at[n - 1:n - 1 + m]
            found.append((h[whole], at[:m][whole]))
    lexicon = np.fromiter((hash_word(w) for w in words), np.uint64, len(words))
    found.append((lexicon, np.arange(len(words))))
    f = np.concatenate([x for x, _ in found]) & np.uint64((1 << HASH_BITS) - 1)
    w = np.concatenate([x for _, x in found])
    n = np.bincount(w, minlength=len(words))
    return f.astype(np.int64), w, (1 / np.sqrt(np.maximum(n, 1)))[w]


def hash_word(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word, 7)


@dataclass
class Marginals:
    """Label probabilities of each word, the expected transitions, and the log-likelihood's normaliser."""

    words: np.ndarray
    transitions: np.ndarray


def forward_backward(emission: np.ndarray, begins: np.ndarray, transition: np.ndarray) -> Marginals:
    """Exact marginals of chains laid end to end; ``begins`` marks each chain's first word.

    A chain begins from equal probabilities, whatever came before it, so one
    recursion serves all. Chunks of ``CHUNK`` words are summed up in transfer
    matrices, the chunks' edges are then found in order, and the words inside all chunks together.
    """
    n, k = emission.shape
    rows = max(1, -(-n // CHUNK))
    e = np.ones((rows * CHUNK, k))
    e[:n] = np.exp(emission - emission.max(axis=1, keepdims=True))
    first = np.ones(rows * CHUNK, bool)
    first[:n] = begins
    e, first = e.reshape(rows, CHUNK, k), first.reshape(rows, CHUNK)
    step = np.exp(transition - transition.max())
    even = np.full((k, k), 1 / k)

    def norm(x, axis):
        return x / x.sum(axis=axis, keepdims=True)

    # transfer matrix of each chunk
    through = np.broadcast_to(np.eye(k), (rows, k, k))
    for t in range(CHUNK):
        moved = np.where(first[:, t, None, None], through.sum(axis=2, keepdims=True) / k, through @ step)
        through = norm(moved * e[:, t, None, :], (1, 2))
    # probabilities at the edges of the chunks
    left, right = np.empty((rows, k)), np.empty((rows, k))
    a = np.full(k, 1 / k)
    for r in range(rows):
        left[r] = a
        a = a @ through[r]
        a = a / a.sum()
    b = np.full(k, 1 / k)
    for r in range(rows - 1, -1, -1):
        right[r] = b
        b = through[r] @ b
        b = b / b.sum()
    alpha, before = np.empty_like(e), np.empty_like(e)
    a = left
    for t in range(CHUNK):
        before[:, t] = a
        a = norm(np.where(first[:, t, None], 1 / k, a @ step) * e[:, t], 1)
        alpha[:, t] = a
    beta = np.empty_like(e)
    b = right
    for t in range(CHUNK - 1, -1, -1):
        beta[:, t] = b
        b = e[:, t] * b
        b = norm(np.where(first[:, t, None], (b @ even.T), b @ step.T), 1)
    words = norm((alpha * beta).reshape(-1, k)[:n], 1)
    s, g = before.reshape(-1, k)[:n][~begins], (e * beta).reshape(-1, k)[:n][~begins]
    d = ((s @ step) * g).sum(axis=1, keepdims=True)
    return Marginals(words, step * ((s / d).T @ g))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    transition: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        f, w, v = features(words)
        return np.stack([np.bincount(w, weights=self.weights[f, k] * v, minlength=len(words))
                         for k in range(len(self.languages))], axis=1)


def sequences(sample: pd.DataFrame, seed: int = 7) -> Iterator[list[tuple[str, str]]]:
    """Training chains of (word, language): half the documents whole, the others' lines mixed."""
    rng = np.random.default_rng(seed)
    sample = sample.sort_values(["lang", "doc_id"], kind="stable").reset_index(drop=True)
    whole = rng.random(len(sample)) < 0.5
    lines = []
    for keep, lang, text in zip(whole, sample["lang"], sample["text"]):
        if keep:
            yield [(w, lang) for w in words_of(text)]
        else:
            lines += [(lang, x) for x in text.split("\n")]
    order = rng.permutation(len(lines))
    for lo in range(0, len(order), 8):
        yield [(w, lines[i][0]) for i in order[lo:lo + 8] for w in words_of(lines[i][1])]


def train(sample: pd.DataFrame, steps: int = 40, rate: float = 1.0, ridge: float = 1e-5) -> Model | None:
    """Fit weights and transitions to (doc_id, lang, text) rows."""
    chains = [c for c in sequences(sample) if c]
    languages = sorted(sample["lang"].unique())
    if not chains:
        return None
    index = {x: i for i, x in enumerate(languages)}
    flat = [x for c in chains for x in c]
    label = np.array([index[x] for _, x in flat])
    begins = np.zeros(len(flat), bool)
    begins[np.cumsum([0, *map(len, chains[:-1])])] = True
    vocabulary: dict[str, int] = {}
    word = np.array([vocabulary.setdefault(w, len(vocabulary)) for w, _ in flat])
    f, w, v = features(list(vocabulary))
    k, n = len(languages), len(flat)
    gold = np.stack([np.bincount(word, weights=label == j, minlength=len(vocabulary)) for j in range(k)], axis=1)
    inside = ~begins
    inside[0] = False
    turns = np.zeros((k, k))
    np.add.at(turns, (label[np.flatnonzero(inside) - 1], label[inside]), 1)
    model = Model(languages, np.zeros((1 << HASH_BITS, k)), np.zeros((k, k)))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.weights, model.transition)]
    for t in range(1, steps + 1):
        e = np.stack([np.bincount(w, weights=model.weights[f, j] * v, minlength=len(vocabulary)) for j in range(k)], axis=1)
        m = forward_backward(e[word], begins, model.transition)
        got = np.stack([np.bincount(word, weights=m.words[:, j], minlength=len(vocabulary)) for j in range(k)], axis=1)
        diff = (gold - got) / n
        grads = (np.stack([np.bincount(f, weights=diff[w, j] * v, minlength=1 << HASH_BITS) for j in range(k)], axis=1)
                 - ridge * model.weights, (turns - m.transitions) / n - ridge * model.transition)
        for p, g, mo in zip((model.weights, model.transition), grads, moments):
            mo[0] = 0.9 * mo[0] + 0.1 * g
            mo[1] = 0.99 * mo[1] + 0.01 * g * g
            p += rate * (mo[0] / (1 - 0.9**t)) / (np.sqrt(mo[1] / (1 - 0.99**t)) + 1e-4)
    return model


def training_sample(docs: DataFrame, per_language: int, train_chars: int) -> DataFrame:
    """(doc_id, lang, text) of at most ``per_language`` documents a language; ``docs`` has the training rows."""
    keys = docs.where((F.length("text") <= train_chars) & (F.length("text") > 0)).select("doc_id", "lang").where(
        "lang IS NOT NULL")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = keys.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).select("doc_id", "lang")
    return docs.join(F.broadcast(few.distinct()), ["doc_id", "lang"]).select("doc_id", "lang", "text").dropDuplicates(
        ["doc_id", "lang"])


def label(docs: DataFrame, model: Model | None, names: tuple[str, str] = ("lang_pred", "score"), keep_text: bool = False,
          keep_words: int = 200_000) -> DataFrame:
    """``docs`` (``text`` and others) with the language and its score, named ``names``, for the text or beside it."""
    kept = [c for c in docs.columns if (keep_text or c != "text") and c not in names]
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(UNKNOWN).alias(names[0]), F.lit(0.0).alias(names[1]))
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights.astype(np.float32), model.transition))
    out = [*kept, *names]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Model(*sent.value)
        k = len(crf.languages)
        named = np.array([*crf.languages, UNKNOWN], object)
        known: dict[str, int] = {}
        scores = np.empty((0, k))
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in by_bytes(texts, 1 << 20):
                words = [words_of(t) for t in texts[lo:hi]]
                new = list(set().union(*words).difference(known))
                if len(known) + len(new) > keep_words:
                    known, scores, new = {}, np.empty((0, k)), list(set().union(*words))
                if new:
                    known.update(zip(new, range(len(known), len(known) + len(new))))
                    scores = np.concatenate([scores, crf.emissions(new)])
                size = np.fromiter(map(len, words), np.int64, len(words))
                ids = np.fromiter((i for w in words for i in map(known.__getitem__, w)), np.int64, int(size.sum()))
                mean = np.zeros((hi - lo, k))
                if len(ids):
                    begins = np.zeros(len(ids), bool)
                    begins[(np.cumsum(size) - size)[size > 0]] = True
                    p = forward_backward(scores[ids], begins, crf.transition).words
                    text = np.repeat(np.arange(hi - lo), size)
                    mean = np.stack([np.bincount(text, weights=p[:, j], minlength=hi - lo) for j in range(k)], axis=1)
                    mean /= np.maximum(size, 1)[:, None]
                best = np.where(size > 0, mean.argmax(axis=1), k)
                top = np.clip(mean.max(axis=1), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(lo, hi - lo) for c in kept],
                                                  pa.array(named[best], pa.string()), pa.array(top)], names=out)

    fields = [f"`{c}` {t}" for c, t in docs.dtypes if c in kept]
    return docs.mapInArrow(rows, ", ".join([*fields, f"`{names[0]}` string", f"`{names[1]}` double"]))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = FOLDS,
        held_out: int = HELD_OUT, per_language: int = 200, train_chars: int = 20_000) -> Model | None:
    """Learn from the documents whose fold is not ``held_out``."""
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    d = d.where(fold("doc_id", folds) != held_out)
    sample = training_sample(d, per_language, train_chars).toPandas()
    return train(sample) if len(sample) else None
