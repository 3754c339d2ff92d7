import random
import re

import numpy as np
import pytest

from subrecon.llm import setsketch as S
from subrecon.llm.common import staged

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, percent=80):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = (min(ids) if ids else None) if sets[i] else doc
        out.append((doc, len(sets[i]), component, doc == component))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def families(rng, n, copies, words=60, change=(1, 12)):
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(n):
        base = rng.choices(vocabulary, k=words)
        texts.append(" ".join(base))
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(*change)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    return texts


def test_matches_brute_force_around_the_threshold(spark, docs_of):
    rng = random.Random(1)
    texts = families(rng, 25, 8)
    rows = list(enumerate(texts)) + [(1000 + i, texts[i].upper()) for i in range(0, 100, 7)]
    rng.shuffle(rows)
    got = S.near_duplicates(docs_of(rows).repartition(4))
    assert found(got) == brute(rows)


@pytest.mark.parametrize("hot, task_bytes", [(7, 50_000), (500, 8_000)])
def test_hot_buckets_are_met_whole(spark, docs_of, hot, task_bytes):
    rng = random.Random(hot)
    texts = families(rng, 2, 60, change=(1, 9)) + families(rng, 10, 2)
    rows = list(enumerate(texts))
    assert found(S.near_duplicates(docs_of(rows).repartition(3), hot=hot, task_bytes=task_bytes)) == brute(rows)


def test_odd_rows(spark, docs_of):
    long = " ".join(f"x{i}" for i in range(400_000))
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "One"), (9, "one"), (3, "two words"), (4, "Two\nwords"), (None, "two words"),
            (None, "lonely text here"), (None, "lonely text here"), (8, "entirely different words"), (2, long), (1, long + " end"),
            (11, "y" * 6_000_000), (12, "É é"), (13, "é é"), (10, "a b c"), (10, "a b c")]
    got = found(S.near_duplicates(docs_of(rows)))
    assert got == brute(rows)
    kept = [r for r in got if r[0] is None]
    assert [r[3] for r in kept if r[2] is None] == [True, True]


def test_empty_and_clashing(spark, docs_of):
    assert found(S.near_duplicates(docs_of([]))) == []
    docs = spark.createDataFrame([(1, "a b c", 5, "x", 7), (2, "A b c", 6, "y", 8)],
                                 "doc_id long, text string, row int, digest string, n int")
    assert [r[:3] for r in found(S.near_duplicates(docs))] == [(1, 2, 1), (2, 2, 1)]


def test_pieces_of_a_long_text_give_its_set():
    rng = random.Random(3)
    text = " ".join(rng.choice(["aa", "b", "éè", "c" * 30, "dd\t"]) + str(rng.randrange(90)) for _ in range(4000)).encode()
    whole, edge = S.sets_of([text])
    for limit in (50, 1000, 1 << 14):
        parts, _ = S.sets_of([text], limit=limit)
        assert np.array_equal(parts, whole)
    assert np.array_equal(S.sketch_set(whole, 7), S.registers(whole, edge[:1])[0])
    assert len(whole) == len(shingle_set(text.decode()))


def test_registers_merge_and_agree_as_often_as_the_sets_do():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    x, y = a[:1500], a[500:]
    sx, sy = S.sketch_set(x), S.sketch_set(y)
    assert np.array_equal(S.merged(sx, sy), S.sketch_set(a))
    hits = [np.mean(S.sketch_set(x * np.uint64(2 * k + 1)) == S.sketch_set(y * np.uint64(2 * k + 1))) for k in range(40)]
    assert abs(np.mean(hits) - 0.5) < 0.03


def test_joint_estimate():
    rng = np.random.default_rng(1)
    for shared, own_a, own_b in ((800, 100, 100), (800, 200, 0), (500, 300, 100), (100, 900, 900)):
        guess = []
        for _ in range(25):
            e = rng.integers(0, 1 << 63, shared + own_a + own_b).astype(np.uint64)
            a, b = e[:shared + own_a], np.r_[e[:shared], e[shared + own_a:]]
            x, y = S.sketch_set(a), S.sketch_set(b)
            counts = [np.array([c]) for c in ((x > y).sum(), (x < y).sum(), (x == y).sum())]
            guess.append(S.estimated(*counts, np.array([float(len(a))]), np.array([float(len(b))]))[0])
        true = shared / (shared + own_a + own_b)
        assert abs(np.mean(guess) - true) < 0.03
        grid = np.linspace(0, min(len(a) / len(b), len(b) / len(a)), 2001)
        best = grid[np.argmax([S.log_likelihood(np.array([j]), *counts, float(len(a)), float(len(b)))[0] for j in grid])]
        assert abs(best - guess[-1]) < 2e-3


def test_a_failed_edge_hides_no_link(spark, docs_of):
    """With a small threshold margin many forest edges fail; the rest is found by running again."""
    rng = random.Random(11)
    rows = list(enumerate(families(rng, 6, 25, words=40, change=(2, 8))))
    assert found(S.near_duplicates(docs_of(rows))) == brute(rows)


def test_links_do_not_depend_on_partitions(spark, docs_of):
    rows = list(enumerate(families(random.Random(4), 8, 5)))
    docs = staged(docs_of(rows), "test-docs")
    assert found(S.near_duplicates(docs.repartition(7))) == found(S.near_duplicates(docs.coalesce(1)))


def test_a_comparison_takes_few_evaluations(monkeypatch):
    """The estimate dominated the search: 114 evaluations of the register probability for each call, however few its pairs."""
    calls, p = [], S._p
    monkeypatch.setattr(S, "_p", lambda x: calls.append(1) or p(x))
    rng = np.random.default_rng(5)
    e = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = [e[:280], e[10:290], e[20:]]
    sketch, n = np.stack([S.sketch_set(x) for x in sets]), np.array([280, 280, 280])
    i, j = np.array([0, 0, 1]), np.array([1, 2, 2])
    band = (sketch.view("<u8")[i] == sketch.view("<u8")[j]).argmax(axis=1)
    guess = S.compared(sketch, n, i, j, band, 80)
    assert (guess > 0.7).all() and len(calls) <= 32
