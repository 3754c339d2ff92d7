import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from subrecon.llm import bitplane_kmeans as B

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                        T.StructField("cluster", T.StringType()), T.StructField("planes", T.IntegerType())])


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS)


def whole(x, scale=64):
    return math.floor(x * scale) if abs(x) < 2.0 ** 40 else int(x) * scale


def brute(rows, clusters=16, rounds=3):
    kept = [(i, [whole(x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())[:clusters]
    centroids = [v for _, v in first]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((i, d.index(min(d)), min(d), v))
        return out
    for _ in range(rounds):
        found = assign()
        for k in range(len(centroids)):
            own = [v for _, c, _, v in found if c == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    total = sum(d for _, _, d, _ in found)
    fits = lambda x: x if x < 1 << 63 else None
    return sorted((i, k, fits(d), fits(sum(e for _, c, e, _ in found if c == k)), fits(total),
                   hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, k, d, _ in found)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_planes_hold_the_integers_and_their_dot_products():
    rng = np.random.default_rng(3)
    for size in (1, 7, 20, 27):
        a, b = (rng.integers(-(1 << size), 1 << size, (9, 64)) for _ in range(2))
        pa_, pb = B.pack(a), B.pack(b)
        assert [B.unpack(p) for p in pa_] == a.tolist()
        assert B.dot(pa_, pb).tolist() == (a * b).sum(axis=1).tolist()
        assert B.dot(pa_, pb[:1]).tolist() == (a * b[0]).sum(axis=1).tolist()
    huge = np.array([[(-1) ** j * 3 ** (j + 20) for j in range(64)]], object)
    assert B.unpack(B.pack(huge)[0]) == huge[0].tolist()
    assert B.dot(B.pack(huge), B.pack(huge))[0] == sum(x * x for x in huge[0])


def test_zero_needs_one_plane():
    zero = B.pack(np.zeros((2, 64), np.int64))
    assert zero.shape == (2, 1) and B.unpack(zero[0]) == [0] * 64


@pytest.mark.parametrize("n, ties", [(300, False), (120, True), (9, False), (1, False)])
def test_matches_brute_force(spark, n, ties):
    rng = random.Random(n)
    value = (lambda: rng.choice([-0.5, 0.0, 0.25])) if ties else (lambda: rng.gauss(0, 0.4))
    rows = [(i, [value() for _ in range(64)]) for i in range(n)]
    rows += [(1000 + i, rows[i % n][1]) for i in range(n // 4)]  # the same vector under other ids
    got, _ = B.cluster(spark, vectors_of(spark, rows).repartition(3))
    assert result(got) == brute(rows)


def test_odd_vectors_are_left_out(spark):
    rng = random.Random(2)
    good = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(20)]
    bad = [(50, None), (51, []), (52, [0.5] * 63), (53, [0.5] * 65), (54, [0.5] * 63 + [None]),
           (55, [float("nan")] + [0.5] * 63), (56, [float("inf")] + [0.5] * 63), (57, [float("-inf")] + [0.5] * 63)]
    got, _ = B.cluster(spark, vectors_of(spark, good + bad))
    assert result(got) == brute(good)
    empty, centroids = B.cluster(spark, vectors_of(spark, bad))
    assert result(empty) == [] and centroids == []
    assert result(B.cluster(spark, vectors_of(spark, []))[0]) == []


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(30)]
    rows += [(100 + i, [rng.gauss(0, 1) * 10.0 ** (4 * i) for _ in range(64)]) for i in range(12)]
    assert result(B.cluster(spark, vectors_of(spark, rows))[0].where("distance is not null").select(
        "vec_id", "cluster", "distance")) == [r[:3] for r in brute(rows) if r[2] is not None]
    assert B.cluster(spark, vectors_of(spark, rows))[0].where("distance is null").count() == sum(
        r[2] is None for r in brute(rows))


def test_null_and_repeated_ids(spark):
    rng = random.Random(6)
    rows = [(1, [rng.gauss(0, 1) for _ in range(64)]) for _ in range(10)] + [
        (None, [rng.gauss(0, 1) for _ in range(64)]) for _ in range(10)]
    one, two = (result(B.cluster(spark, vectors_of(spark, x).coalesce(1))[0].fillna(-1)) for x in (rows, rows[::-1]))
    assert len(one) == 20 and one == two  # whatever the order of rows
