"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (``passage_words`` consecutive words). Every
passage is encoded: measures of its characters, words and repetitions,
standardised, go through a learned hidden layer. Gated attention (a tanh layer times
a sigmoid layer) weighs the passages; the weighted sum of their encodings is the
document's representation, and a logistic unit scores it. All layers are
learned together from document labels by Adam on the driver, from a bounded sample
(``per_class`` labelled documents of each label, lowest hash first, of at most
``train_chars`` characters), weighted back to the labels' own shares; the
few hundred weights are sent to the tasks.

Defined results: a null or empty text is one passage without words; null
labels are no labels; an id labelled twice has its lowest label; without
training rows of both labels every score is the share of label 1 (zero
without any); repeated rows score alike; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subrecon.llm.common import SPACED, by_bytes, fold, mix64, staged, text_bytes, words_of

PASSAGE_WORDS = 64
FOLDS, HELD_OUT = 4, 2
HIDDEN, GATE = 16, 8

_BYTE = np.arange(256)
#: Byte classes whose shares describe a passage.
CLASSES = {
    "lower": (_BYTE >= 97) & (_BYTE <= 122),
    "upper": (_BYTE >= 65) & (_BYTE <= 90),
    "digit": (_BYTE >= 48) & (_BYTE <= 57),
    "wide": _BYTE >= 128,
    "stop": np.isin(_BYTE, list(b".,;:?")),
    "shout": _BYTE == ord("!"),
    "symbol": np.isin(_BYTE, list(b"#*$%&|<>")),
    "other": np.isin(_BYTE, list(b"\"'()-/@[]\\^_`{}~+=")),
}
FEATURES = (*CLASSES, "word_length", "no_letters", "with_symbol", "short_words", "new_words", "same_as_before",
            "repeated_triples", "size", "document_size")


def passages(texts: list[bytes], passage_words: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(features, text of each) of every passage; each text has at least one."""
    w = words_of(texts, SPACED, lower=False)
    in_text = np.arange(len(w.start)) - (np.cumsum(w.count) - w.count)[w.text]
    per_text = np.maximum(1, -(-w.count // passage_words))
    first = np.cumsum(per_text) - per_text
    text = np.repeat(np.arange(len(texts)), per_text)
    n = len(text)
    at = first[w.text] + in_text // passage_words
    count = np.bincount(at, minlength=n)
    safe = np.maximum(count, 1)
    out = np.zeros((n, len(FEATURES)))
    total = np.bincount(at, weights=w.end - w.start, minlength=n)
    in_word = {}
    for j, (name, members) in enumerate(CLASSES.items()):
        sums = np.r_[0, np.cumsum(members[w.buf])]
        in_word[name] = sums[w.end] - sums[w.start]
        out[:, j] = np.bincount(at, weights=in_word[name], minlength=n) / np.maximum(total, 1)
    share = lambda x: np.bincount(at, weights=x, minlength=n) / safe
    h = w.hashes()
    j = len(CLASSES)
    out[:, j] = total / safe / 10
    out[:, j + 1] = share(in_word["lower"] + in_word["upper"] + in_word["wide"] == 0)
    out[:, j + 2] = share(in_word["symbol"] > 0)
    out[:, j + 3] = share(w.end - w.start <= 3)
    keys = mix64(h + np.uint64(0x9E3779B97F4A7C15) * at.astype(np.uint64))
    new = np.zeros(len(h), bool)
    new[np.unique(keys, return_index=True)[1]] = True
    out[:, j + 4] = share(new)
    before = np.zeros(len(h), bool)
    before[1:] = (h[1:] == h[:-1]) & (w.text[1:] == w.text[:-1])
    out[:, j + 5] = share(before)
    triple = np.zeros(len(h), bool)
    if len(h) > 2:
        one = (w.text[2:] == w.text[:-2])
        key = mix64(mix64(h[:-2] + w.text[:-2].astype(np.uint64)) + np.uint64(3) * h[1:-1] + np.uint64(7) * h[2:])
        # only triples within a text count: one that reaches into the next text is none
        _, inverse, times = np.unique(key[one], return_inverse=True, return_counts=True)
        triple[:-2][one] = times[inverse] > 1
    out[:, j + 6] = share(triple)
    out[:, j + 7] = np.log1p(count)
    out[:, j + 8] = np.log1p(w.count)[text]
    return out, text


@dataclass
class Model:
    """Standardisation and layers; ``weights`` in the order encode, gate, score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> dict:
        w1, b1, v, u, a, c, d = self.weights
        h = np.tanh(((x - self.mean) / self.scale) @ w1 + b1)
        t, g = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        e = (t * g) @ a
        top = np.full(bags, -np.inf)
        np.maximum.at(top, bag, e)
        e = np.exp(e - top[bag])
        att = e / np.bincount(bag, weights=e, minlength=bags)[bag]
        z = np.stack([np.bincount(bag, weights=att * h[:, j], minlength=bags) for j in range(h.shape[1])], axis=1)
        return {"h": h, "t": t, "g": g, "att": att, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ c + d, -30, 30)))}


def train(x: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 300, rate: float = 0.02,
          ridge: float = 1e-4, seed: int = 11) -> Model:
    """Fit all layers to bag labels by full-batch Adam."""
    rng = np.random.default_rng(seed)
    f = x.shape[1]
    shapes = [(f, HIDDEN), (HIDDEN,), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN,), ()]
    m = Model(x.mean(axis=0), x.std(axis=0) + 1e-6, [rng.normal(0, s[0] ** -0.5, s) if len(s) > 1 else
                                                     (rng.normal(0, 0.3, s) if s in ((GATE,), (HIDDEN,)) else np.zeros(s)) for s in shapes])
    m.weights[1] = np.zeros(HIDDEN)
    xs, n, bags = (x - m.mean) / m.scale, weight.sum(), len(y)
    mo = [(np.zeros_like(w), np.zeros_like(w)) for w in m.weights]
    for step in range(1, steps + 1):
        w1, b1, v, u, a, c, d = m.weights
        o = m.forward(x, bag, bags)
        dz = weight * (o["p"] - y) / n
        gc, gd = o["z"].T @ dz, dz.sum()
        dzh = dz[:, None] * c
        each = dzh[bag]
        datt = (each * o["h"]).sum(axis=1)
        mean = np.bincount(bag, weights=o["att"] * datt, minlength=bags)[bag]
        de = o["att"] * (datt - mean)
        tg = o["t"] * o["g"]
        dt = de[:, None] * a * o["g"] * (1 - o["t"] ** 2)
        dg = de[:, None] * a * tg * (1 - o["g"])
        dh = (o["att"][:, None] * each + dt @ v.T + dg @ u.T) * (1 - o["h"] ** 2)
        grads = [xs.T @ dh, dh.sum(axis=0), o["h"].T @ dt, o["h"].T @ dg, tg.T @ de, gc, gd]
        for i, (w, g) in enumerate(zip(m.weights, grads)):
            g = g + ridge * w
            one, two = mo[i]
            mo[i] = one, two = 0.9 * one + 0.1 * g, 0.999 * two + 0.001 * g * g
            m.weights[i] = w - rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    return m


def training_sample(labelled: DataFrame, per_class: int, train_chars: int) -> DataFrame:
    """At most ``per_class`` rows (doc_id, y, text) of each label."""
    keys = labelled.where(F.length(F.coalesce("text", F.lit(""))) <= train_chars).select("doc_id", "y").distinct()
    keys = staged(keys, "quality-keys")
    # the lowest of each label, found in each task first: no task holds all rows of a label
    no, yes = (keys.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1))
    return labelled.join(F.broadcast(no.unionByName(yes)), ["doc_id", "y"]).select("doc_id", "y", "text").dropDuplicates(["doc_id"])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        folds: int = FOLDS, held_out: int = HELD_OUT, per_class: int = 2_000, train_chars: int = 20_000,
        max_label_rows: int = 4_000_000) -> tuple[Model | None, float]:
    """(model, share of label 1) from the rows whose fold is not ``held_out``; no model without both labels."""
    y = labels.where(F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("doc_id")).agg(
        (F.min(f"`{label}`") > 0).cast("int").alias("y")).where(fold("doc_id", folds) != held_out)
    sizes = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}
    total = sum(sizes.values())
    share = sizes.get(1, 0) / total if total else 0.0
    if len(sizes) < 2:
        return None, share
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    labelled = d.join(F.broadcast(y) if total <= max_label_rows else y, "doc_id")
    sample = training_sample(labelled, per_class, train_chars).toPandas()
    if sample["y"].nunique() < 2:
        return None, share
    sample = sample.sort_values("doc_id").reset_index(drop=True)
    texts, x, bag = [(t or "").encode("utf-8", "surrogatepass") for t in sample["text"]], [], []
    for lo, hi in by_bytes(texts, 2 << 20):  # some texts at a time, for the driver's memory
        part, at = passages(texts[lo:hi])
        x.append(part)
        bag.append(at + lo)
    x, bag = np.concatenate(x), np.concatenate(bag)
    target = sample["y"].to_numpy(float)
    taken = sample["y"].value_counts()
    weight = np.array([sizes[v] / taken[v] for v in sample["y"]])
    return train(x, bag, target, weight), share


def score(docs: DataFrame, model: Model | None, share: float) -> DataFrame:
    """``docs`` with ``score`` in place of ``text``."""
    names = [c for c in docs.columns if c != "text"]
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != "text")
    if model is None:
        return docs.select(*names, F.lit(float(share)).alias("score"))
    mean, scale, weights = model.mean, model.scale, model.weights

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Model(mean, scale, weights)
        for b in batches:
            texts = text_bytes(b.column("text"))
            for lo, hi in by_bytes(texts, 2 << 20):
                x, bag = passages(texts[lo:hi])
                p = net.forward(x, bag, hi - lo)["p"]
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(lo, hi - lo) for c in names], pa.array(p)],
                                                 names=[*names, "score"])

    return docs.mapInArrow(rows, f"{fields}{', ' if fields else ''}score double")
