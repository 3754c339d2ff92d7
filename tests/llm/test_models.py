"""The learned operators: held-out accuracy, exactness of their parts, and edge cases."""

import itertools

import numpy as np
import pytest

from llm_paths import SF_SMALL
from subrecon.llm import language_id, quality_classifier, toxicity
from subrecon.llm.common import staged
from subrecon.llm.queries import QUERIES, op5_language_id

SF = SF_SMALL.replace("0.001", "0.01")
EDGE = [None, "", " \n", "123 456", "...", "x", "word " * 50_000, "é", "漢字 かな", "same text here", "same text here", "\x00"]


def held_out(spark, name, label):
    got = {r["doc_id"]: r for r in QUERIES[name](spark, SF).collect()}
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/{'documents' if label == 'lang' else 'labels'}.parquet").collect()}
    return got, [(got[i], y) for i, y in truth.items() if y is not None and got[i]["held_out"]]


def auc(pairs):
    one, zero = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a, b in itertools.product(one, zero)])


def test_language_accuracy(spark):
    got, pairs = held_out(spark, "op5_language_id", "lang")
    assert np.mean([r["lang_pred"] == y for r, y in pairs]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_quality_accuracy(spark):
    got, pairs = held_out(spark, "op6_quality_classifier", "quality")
    assert auc([(r["score"], y) for r, y in pairs]) >= 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_toxicity_ranks_held_out_documents(spark, docs_of):
    rng = np.random.default_rng(1)
    plain, bad = [f"word{i}" for i in range(200)], ["idiotic", "moronic", "scummy"]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 4 == 0
        w = list(rng.choice(plain, 60)) + (list(rng.choice(bad, 3)) if toxic else [])
        rows.append((i, " ".join(rng.permutation(w))))
        labels.append((i, int(toxic)))
    d, y = docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(d, y).collect()
    out = [(r["score"], r["doc_id"] % 4 == 0) for r in got if r["held_out"]]
    assert auc(out) > 0.99 and np.mean([(s >= 0.5) == t for s, t in out]) > 0.97
    joined = {r["doc_id"]: r["score"] for r in toxicity.score(d, y, max_model_rows=0, max_label_rows=0).collect()}
    assert all(abs(joined[r["doc_id"]] - r["score"]) < 1e-9 for r in got)


def test_toxicity_model_against_brute_force(spark):
    """Conditional Kneser-Ney written out: shared continuation counts below class counts."""
    from collections import Counter, defaultdict

    order, d, k = 4, 0.75, 8.0
    rng = np.random.default_rng(7)
    letters = list("abcdé") + ["\U00010400"]
    rows = [(" ".join("".join(rng.choice(letters, rng.integers(1, 6))) for _ in range(12)), bool(i % 3 == 0) if i % 5 else None, i % 4 == 0)
            for i in range(60)] + [(None, None, False), ("", True, False), ("abab abab cab", True, False)]
    words = toxicity.count_words(spark.createDataFrame(rows, "text string, toxic boolean, fit boolean"))
    grams = toxicity.staged(toxicity.count_expressions(words, order), "test-grams")
    got = {r["gram"]: (r["llr"], r["llr_fit"]) for r in toxicity.class_models(grams, order, d, k).collect()}

    cut = lambda w: [(" " * (order - 1) + w + " ")[i:i + order] for i in range(len(w) + 1)]
    n, c = Counter(), defaultdict(Counter)
    for w in {w for t, _, _ in rows for w in (t or "").lower().split()}:
        n.update(cut(w))
    for text, toxic, fit in rows:
        for w in set((text or "").lower().split()) if toxic is not None else ():
            c[toxic].update(cut(w))
            if not fit:
                c[toxic, "fit"].update(cut(w))
    levels = {order: n}
    for m in range(order - 1, 0, -1):
        levels[m] = Counter(g[1:] for g in levels[m + 1])

    def kn(counts, g, lower):
        of = {x: v for x, v in counts.items() if x[:-1] == g[:-1]}
        if not sum(of.values()):
            return lower
        return (max(counts.get(g, 0) - d, 0) + sum(min(v, d) for v in of.values()) * lower) / sum(of.values())

    def shared(g):
        return kn(levels[len(g)], g, shared(g[1:]) if len(g) > 1 else 1 / len(levels[1]))

    def p(counts, g):
        s = shared(g)
        seen = any(x[:-1] == g[:-1] and v for x, v in counts.items())
        return (kn(counts, g, s) + k * s) / (1 + k) if seen else s

    for g in n:
        want = (np.log(p(c[True], g) / p(c[False], g)), np.log(p(c[True, "fit"], g) / p(c[False, "fit"], g)))
        assert np.allclose(got.get(g, (0.0, 0.0)), want, atol=1e-9), g
    assert set(got) <= set(n) and any(abs(a) > 0.01 for a, _ in got.values())

    texts = spark.createDataFrame([(0, "abab cab, abab!"), (1, None), (2, "..."), (3, "zz")], "id int, text string")
    table = toxicity.class_models(grams, order, d, k).select("gram", "llr")
    ratio = {r["id"]: r["ratio"] for r in toxicity.ratio_sent(texts, table, order).collect()}
    llr = lambda w: sum(got.get(g, (0.0, 0.0))[0] for g in cut(w))
    assert abs(ratio[0] - (2 * llr("abab") + llr("cab")) / 14) < 1e-9
    assert ratio[1] == ratio[2] == 0.0
    # every conditional distribution over the characters seen anywhere sums to one
    h = next(iter(n))[:-1]
    assert abs(sum(p(c[True], h + x) for x in levels[1]) - 1) < 1e-9


def test_toxicity_counts_texts_by_word(spark):
    rows = [("Abc abc de", True, False), ("abc xyz", False, True), (None, None, False), ("abcd!", None, False)]
    words = toxicity.count_words(spark.createDataFrame(rows, "text string, toxic boolean, fit boolean"))
    assert sorted(map(tuple, words.collect())) == [("abc", 1, 1, 1, 0), ("abcd", 0, 0, 0, 0), ("de", 1, 0, 1, 0), ("xyz", 0, 1, 0, 0)]
    grams = {r["gram"]: (r["tox"], r["ord"], r["tox_fit"], r["n"]) for r in toxicity.count_expressions(words, 4).collect()}
    assert grams[" abc"] == (1, 1, 1, 2) and grams["abc "] == (1, 1, 1, 1) and grams["   d"] == (1, 0, 1, 1)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    n, k = 400, 3
    e, t = rng.normal(size=(n, k)) * 2, rng.normal(size=(k, k))
    begins = rng.random(n) < 0.05
    begins[0] = True
    m = language_id.forward_backward(e, begins, t)
    edges = [*np.flatnonzero(begins), n]
    turns = np.zeros((k, k))
    for a, b in zip(edges, edges[1:]):
        alpha, beta = np.exp(e[a:b] - e[a:b].max()), np.ones((b - a, k))
        x, step = alpha.copy(), np.exp(t)
        for i in range(1, b - a):
            alpha[i] = (alpha[i - 1] @ step) * x[i]
        for i in range(b - a - 2, -1, -1):
            beta[i] = step @ (x[i + 1] * beta[i + 1])
        z = alpha[-1].sum()
        assert np.allclose(m.words[a:b], alpha * beta / z)
        for i in range(1, b - a):
            turns += alpha[i - 1][:, None] * step * (x[i] * beta[i]) / z
    assert np.allclose(m.transitions, turns)


def test_code_switched_words_are_told_apart(spark):
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    words = ["the", "thing", "and", "the", "ering", "nicht", "und", "schung", "einung", "der", "enheit"]
    p = language_id.forward_backward(model.emissions(words), np.arange(len(words)) == 0, model.transition).words
    named = [model.languages[i] for i in p.argmax(axis=1)]
    assert named[:4] == ["en"] * 4 and named[-4:] == ["de"] * 4


def test_attention_gradient(spark):
    rng = np.random.default_rng(3)
    x, bag, y = rng.normal(size=(60, 5)), np.repeat(np.arange(20), 3), (rng.random(20) < 0.5).astype(float)
    x[bag == 0] += 3
    m = quality_classifier.train(x, bag, y, np.ones(20), steps=400, ridge=0.0)
    assert ((m.forward(x, bag, 20)["p"] > 0.5) == y).mean() >= 0.9
    assert np.allclose(np.bincount(bag, weights=m.forward(x, bag, 20)["att"]), 1)


def test_passages_cover_every_word():
    texts = [b"", b"one", b"w " * 130, b"  \n "]
    x, text = quality_classifier.passages(texts)
    assert text.tolist() == [0, 1, 2, 2, 2, 3]
    assert np.allclose(np.expm1(x[:, quality_classifier.FEATURES.index("size")]), [0, 1, 64, 64, 2, 0])


@pytest.mark.parametrize("empty", [False, True])
def test_edge_texts_have_defined_results(spark, docs_of, empty):
    train = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    edge = docs_of([] if empty else list(EDGE)).selectExpr("*", "1 AS score0", "2 AS fold")
    crf = language_id.fit(train)
    got = {r["doc_id"]: r for r in language_id.label(edge.select("doc_id", "text"), crf).collect()}
    assert len(got) == edge.count()
    for i, t in enumerate([] if empty else EDGE):
        letters = any(c.isalpha() for c in t or "")
        assert (got[i]["lang_pred"] == "und") == (not letters) and 0 <= got[i]["score"] <= 1
    model, share = quality_classifier.fit(train, labels)
    assert all(0 <= r["score"] <= 1 for r in quality_classifier.score(edge.select("doc_id", "text"), model, share).collect())
    scored = toxicity.score(edge, labels.where("doc_id < 0")).collect()
    assert [r["score"] for r in scored] == [0.0] * edge.count()


def test_nothing_to_learn_from(spark, docs_of):
    d = docs_of([(1, "the text", None), (None, "x", None)])
    assert language_id.fit(d) is None
    assert [r["lang_pred"] for r in language_id.label(d.select("doc_id", "text"), None).collect()] == ["und"] * 2
    y = spark.createDataFrame([(1, 1, 0), (None, 0, None)], "doc_id long, quality int, toxic int")
    model, share = quality_classifier.fit(d, y)
    assert model is None and 0 <= share <= 1
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(d, y).collect())


def test_labels_of_the_held_out_fold_are_not_used(spark):
    import zlib

    train = staged(spark.read.parquet(f"{SF}/documents.parquet"), "test-docs")
    flipped = train.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 'zz' ELSE lang END AS lang")
    assert "zz" not in language_id.fit(flipped).languages
    assert {r["doc_id"] for r in op5_language_id(spark, SF).where("held_out").collect()} == {
        r["doc_id"] for r in train.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
