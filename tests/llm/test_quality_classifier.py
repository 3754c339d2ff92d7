"""The quality classifier against plain loops: passage features, forward pass, training steps, scores."""

import math
import random

import numpy as np

from subrecon.llm import quality_classifier as qc

KINDS = {
    "lower": lambda b: 97 <= b <= 122, "upper": lambda b: 65 <= b <= 90, "digit": lambda b: 48 <= b <= 57, "wide": lambda b: b >= 128,
    "stop": lambda b: b in b".,;:?", "shout": lambda b: b in b"!", "symbol": lambda b: b in b"#*$%&|<>",
    "other": lambda b: b in b"\"'()-/@[]\\^_`{}~+=",
}


def brute_passages(text, size):
    """One dictionary of features a passage of a text."""
    words = [w for w in "".join("\0" if c in " \t\n\v\f\r" else c for c in text).split("\0") if w]
    words = [w.encode() for w in words]
    triples = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    out = []
    for lo in range(0, max(1, len(words)), size):
        part = words[lo:lo + size]
        n, chars = max(1, len(part)), sum(map(len, part))
        f = {k: sum(is_one(b) for w in part for b in w) / max(1, chars) for k, is_one in KINDS.items()}
        at = range(lo, lo + len(part))
        f["word_length"] = chars / n / 10
        f["no_letters"] = sum(not any(KINDS[k](b) for b in w for k in ("lower", "upper", "wide")) for w in part) / n
        f["with_symbol"] = sum(any(map(KINDS["symbol"], w)) for w in part) / n
        f["short_words"] = sum(len(w) <= 3 for w in part) / n
        f["new_words"] = len(set(part)) / n
        f["same_as_before"] = sum(i > 0 and words[i] == words[i - 1] for i in at) / n
        f["repeated_triples"] = sum(i < len(triples) and triples.count(triples[i]) > 1 for i in at) / n
        f["size"], f["document_size"] = math.log1p(len(part)), math.log1p(len(words))
        out.append(f)
    return out


def brute_score(mean, scale, weights, features):
    """The score of one text from its passages' features, a passage at a time."""
    w1, b1, v, u, a, c, d = weights
    hidden = [np.tanh((np.asarray(x) - mean) / scale @ w1 + b1) for x in features]
    gated = [float(np.tanh(h @ v) * (1 / (1 + np.exp(-(h @ u)))) @ a) for h in hidden]
    total = sum(math.exp(e) for e in gated)
    z = sum(math.exp(e) / total * h for e, h in zip(gated, hidden))
    return 1 / (1 + math.exp(-(float(z @ c) + float(d))))


def odd_texts(rng):
    words = ["the", "The", "é", "##", "a1", "12", "x", "WOW!", "and", "<b>", "naïve", "...", "long-word", "日本"]
    texts = ["", " \t\n ", "one", "a a a a", *(" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(30))]
    return [*texts, "again and again and again \n" * 8, "x y z \x0b w\x1cq"]


def test_passage_features_against_loops():
    texts = odd_texts(random.Random(2))
    x, text = qc.passages([t.encode() for t in texts], 8)
    for i, t in enumerate(texts):
        want = [[f[k] for k in qc.FEATURES] for f in brute_passages(t, 8)]
        assert np.allclose(x[text == i], want, atol=1e-12), t
    # a text's features do not depend on its neighbours
    for i, t in enumerate(texts):
        assert np.allclose(qc.passages([t.encode()], 8)[0], x[text == i])


def test_the_next_text_in_a_batch_changes_nothing():
    alone, _ = qc.passages([b"x y z and x y"])
    beside, text = qc.passages([b"x y z and x y", b"z more"])
    assert np.array_equal(beside[text == 0], alone)


def test_training_steps_against_numeric_gradients():
    rng = np.random.default_rng(6)
    bag = np.repeat(np.arange(6), [1, 2, 3, 1, 4, 2])
    x, y, weight = rng.normal(size=(len(bag), 3)), np.array([0, 1, 1, 0, 1, 0.0]), np.array([1, 2, 1, 0.5, 1, 3.0])
    ridge, rate, steps = 1e-3, 0.02, 4
    start = qc.train(x, bag, y, weight, steps=0, seed=5)
    shapes = [np.shape(w) for w in start.weights]
    flat = np.concatenate([np.ravel(w) for w in start.weights])

    def cut(p):
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        return [q.reshape(s) for q, s in zip(np.split(p, ends[:-1]), shapes)]

    def loss(p):
        at = [brute_score(start.mean, start.scale, cut(p), x[bag == i]) for i in range(len(y))]
        return sum(-w * math.log(q if t else 1 - q) for w, t, q in zip(weight, y, at)) / weight.sum() + ridge / 2 * (p @ p)

    one, two, eps = np.zeros_like(flat), np.zeros_like(flat), 1e-5
    for step in range(1, steps + 1):
        g = np.array([(loss(flat + e) - loss(flat - e)) / (2 * eps) for e in np.eye(len(flat)) * eps])
        one, two = 0.9 * one + 0.1 * g, 0.999 * two + 0.001 * g * g
        flat = flat - rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    got = qc.train(x, bag, y, weight, steps=steps, rate=rate, ridge=ridge, seed=5)
    assert np.allclose(np.concatenate([np.ravel(w) for w in got.weights]), flat, atol=1e-5)


def test_scores_against_loops(spark, docs_of):
    rng = np.random.default_rng(8)
    f, texts = len(qc.FEATURES), [*odd_texts(random.Random(3)), None, "word " * 300]
    weights = [rng.normal(size=s) for s in ((f, 16), (16,), (16, 8), (16, 8), (8,), (16,), ())]
    model = qc.Model(rng.normal(size=f), rng.uniform(0.5, 2, f), weights)
    got = {r["doc_id"]: r["score"] for r in qc.score(docs_of(texts).select("doc_id", "text"), model, 0.5).collect()}
    for i, t in enumerate(texts):
        features = [[p[k] for k in qc.FEATURES] for p in brute_passages(t or "", qc.PASSAGE_WORDS)]
        assert abs(got[i] - brute_score(model.mean, model.scale, weights, features)) < 1e-9, t
