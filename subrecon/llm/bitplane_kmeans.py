"""Centroid clustering over bit planes: exact integer k-means by AND and popcount.

**Planes.** Each component of a vector of 64 becomes an integer (``scale`` times it, floored).
In two's complement of ``w`` bits, bit ``i`` of the 64 components is packed into one
64-bit word, its plane ``i``; the topmost plane weighs ``-2^(w-1)``, the others ``2^i``.
A vector is kept as its ``w`` planes, with the smallest ``w`` that holds
its components, in a written table: 8 ``w`` bytes a vector.

**Distances.** The dot product of two such vectors is the weighted sum, over all
pairs of a plane of one and a plane of the other, of popcount(plane AND
plane); a squared distance is ``|v|^2 - 2 v.c + |c|^2``, each term so computed. All of it is exact.

**Rounds.** Each task assigns its vectors and counts, for each cluster and plane, how often each component's
bit is set; Spark adds these counts over tasks, and the driver reads at most
clusters times planes rows of 64 counts. Their weighted sum is the sum of a cluster's
components, so the new centroid is exact too. Nothing depends on how rows are dealt.

Defined results: vectors that are null, of another length than 64, or with a
null, NaN or infinite component are left out; with fewer kept vectors than
clusters there are as many clusters as vectors; a null id never starts a
centroid unless there are too few others; rows with the same id are vectors of their
own, ordered by their planes where the start needs an order; ties in distance go to the smaller
number; components of any finite size are exact, and a distance or a sum that exceeds a long is null;
no kept vector gives an empty result; other columns are ignored. Vectors have no text, so no long or empty one.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subrecon.llm.common import staged

DIMENSIONS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
#: Planes up to which the sums stay within 63 bits: 64 * (2^28)^2 = 2^62.
SHORT = 28
_LONG_MAX = (1 << 63) - 1


def weights(width: int) -> list[int]:
    """What a set bit of each plane counts: two's complement of ``width`` bits."""
    return [1 << i for i in range(width - 1)] + [-(1 << (width - 1))]


def bits_needed(low: int, high: int) -> int:
    """Smallest two's complement width that holds ``low`` and ``high``."""
    return max((~low if low < 0 else low).bit_length(), (~high if high < 0 else high).bit_length()) + 1


def pack(values: np.ndarray) -> np.ndarray:
    """Planes (rows x width, uint64) of integer rows (rows x 64; int64 or Python integers)."""
    width = bits_needed(int(values.min()), int(values.max()))
    out = np.empty((len(values), width), np.uint64)
    for i in range(width):
        bit = ((values >> i) & 1).astype(np.uint8)
        out[:, i] = np.packbits(bit, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def unpack(planes: np.ndarray) -> list[int]:
    """The 64 integers of one vector's planes."""
    bits = np.unpackbits(planes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return [sum(w * int(b) for w, b in zip(weights(len(planes)), bits[:, j])) for j in range(DIMENSIONS)]


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact dot products of the rows of ``a`` with those of ``b`` (planes; ``b`` one row, or as many as ``a``).

    Weighted AND-popcounts over all pairs of planes; int64 where that cannot
    overflow, Python integers beyond.
    """
    short = max(a.shape[1], b.shape[1]) <= SHORT
    total = np.zeros(len(a), np.int64 if short else object)
    for i, wa in enumerate(weights(a.shape[1])):
        for j, wb in enumerate(weights(b.shape[1])):
            total += np.bitwise_count(a[:, i] & b[:, j]).astype(total.dtype) * (wa * wb)
    return total


def packed_rows(rows: np.ndarray, scale: int = SCALE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and planes of ``floor(scale * x)``, rows of the same width together."""
    large = np.abs(rows).max(axis=1) * scale >= 2.0 ** 50
    at = np.flatnonzero(~large)
    values = np.floor(rows[at] * scale).astype(np.int64)
    width = np.frexp(np.where(values < 0, ~values, values).max(axis=1, initial=0))[1]  # its bits: below 2^53
    for w in np.unique(width):
        yield at[width == w], pack(values[width == w])
    for i in np.flatnonzero(large):  # beyond 50 bits: exact integers, a row at a time
        whole = [math.floor(x * scale) if abs(x) < 2.0 ** 50 else int(x) * scale for x in rows[i].tolist()]
        yield np.array([i]), pack(np.array([whole], object))


def kept_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors that are kept, and their components as doubles."""
    lengths = np.array(column.value_lengths().fill_null(-1))
    at = np.flatnonzero(lengths == DIMENSIONS)
    if not len(at):
        return at, np.empty((0, DIMENSIONS))
    values = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null: NaN
    values = values.reshape(-1, DIMENSIONS)
    finite = np.isfinite(values).all(axis=1)
    return at[finite], values[finite]


def planes_of(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, planes array<long>) of every kept vector."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, values = kept_rows(b.column(1))
            if not len(at):
                continue
            ids = b.column(0).take(pa.array(at))
            for own, planes in packed_rows(values, scale):
                offsets = pa.array(np.arange(len(own) + 1, dtype=np.int32) * planes.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(own)),
                     pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(planes).view(np.int64).ravel()))],
                    names=["vec_id", "planes"])

    return vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
                          F.col(f"`{embedding}`").alias("embedding")).mapInArrow(rows, "vec_id long, planes array<long>")


def _by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and planes of a batch, one width at a time."""
    lengths = np.array(column.value_lengths())
    for w in np.unique(lengths):
        at = np.flatnonzero(lengths == w)
        yield at, column.take(pa.array(at)).flatten().to_numpy().view(np.uint64).reshape(-1, w)


def nearest(planes: np.ndarray, centroids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, and the squared distance to it."""
    own = dot(planes, planes)
    best = number = None
    for k, c in enumerate(centroids):
        d = own - 2 * dot(planes, c[None, :]) + dot(c[None, :], c[None, :])[0]
        if best is None:
            best, number = d, np.zeros(len(d), np.int32)
            continue
        closer = np.asarray(d < best, bool)
        best, number = np.where(closer, d, best), np.where(closer, np.int32(k), number)
    return number, best


def _bit_counts(centroids: list[np.ndarray]):
    """Per task: how often each component's bit is set, by cluster and plane."""
    names = ["cluster", "bit", "top", "n", *[f"c{j}" for j in range(DIMENSIONS)]]
    types = [pa.int32(), pa.int32(), pa.bool_(), pa.int64(), *[pa.int64()] * DIMENSIONS]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = defaultdict(lambda: np.zeros(DIMENSIONS + 1, np.int64))
        for b in batches:
            for _, planes in _by_width(b.column(0)):
                number, _ = nearest(planes, centroids)
                for k in np.unique(number):
                    own = planes[number == k]
                    for i in range(own.shape[1]):
                        bits = np.unpackbits(np.ascontiguousarray(own[:, i]).astype("<u8").view(np.uint8).reshape(-1, 8),
                                             axis=1, bitorder="little")
                        c = counts[int(k), i, i == own.shape[1] - 1]
                        c[1:] += bits.sum(axis=0, dtype=np.int64)
                        c[0] += len(own) if i == own.shape[1] - 1 else 0
        if counts:
            columns = list(zip(*[(*key, *c.tolist()) for key, c in counts.items()]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    kind = {pa.int32(): "int", pa.bool_(): "boolean", pa.int64(): "long"}
    return rows, ", ".join(f"{n} {kind[t]}" for n, t in zip(names, types))


def updated(packed: DataFrame, centroids: list[np.ndarray]) -> list[np.ndarray]:
    """Centroids after one round; a cluster without vectors keeps its own."""
    rows, schema = _bit_counts(centroids)
    counts = packed.select("planes").mapInArrow(rows, schema).groupBy("cluster", "bit", "top").agg(
        *[F.sum(c).alias(c) for c in ["n", *[f"c{j}" for j in range(DIMENSIONS)]]])
    sums: dict[int, list[int]] = defaultdict(lambda: [0] * DIMENSIONS)
    sizes: dict[int, int] = defaultdict(int)
    for r in counts.collect():  # at most clusters x planes x 2 rows
        weight = -(1 << r["bit"]) if r["top"] else 1 << r["bit"]
        sizes[r["cluster"]] += r["n"]
        own = sums[r["cluster"]]
        for j in range(DIMENSIONS):
            own[j] += weight * r[f"c{j}"]
    out = list(centroids)
    for k, n in sizes.items():
        out[k] = pack(np.array([[s // n for s in sums[k]]], object))[0]
    return out


def started(packed: DataFrame, clusters: int = CLUSTERS, salt: str = "1") -> list[np.ndarray]:
    """First centroids: the vectors with the smallest SHA-256 of ``salt:vec_id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = packed.select(key.alias("key"), "planes").orderBy(F.col("key").asc_nulls_last(), "planes").limit(clusters)
    rows = sorted(first.collect(), key=lambda r: (r["key"] is None, r["key"] or "", r["planes"]))
    return [np.array(r["planes"], np.int64).view(np.uint64) for r in rows]


def assigned(packed: DataFrame, centroids: list[np.ndarray]) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, planes in _by_width(b.column(1)):
                number, distance = nearest(planes, centroids)
                exact = pa.array(distance) if distance.dtype != object else pa.array(
                    [d if d <= _LONG_MAX else None for d in distance.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(number, pa.int32()), exact],
                                                 names=["vec_id", "cluster", "distance"])

    return packed.mapInArrow(rows, "vec_id long, cluster int, distance long")


def digest(centroid: np.ndarray) -> str:
    """SHA-256 of a centroid's components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, unpack(centroid))).encode()).hexdigest()


def cluster(spark: SparkSession, vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
            clusters: int = CLUSTERS, rounds: int = ROUNDS, salt: str = "1") -> tuple[DataFrame, list[np.ndarray]]:
    """Every kept vector with its cluster, distance and inertias, and the final centroids (planes)."""
    packed = staged(planes_of(vectors, vec_id, embedding), "bitplane-vectors")
    centroids = started(packed, clusters, salt)
    for _ in range(rounds if centroids else 0):
        centroids = updated(packed, centroids)
    found = staged(assigned(packed, centroids), "bitplane-assigned")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    # a distance beyond a long makes the sums that hold it null, as does a sum beyond a long
    whole = F.when(F.count("distance") == F.count("*"), exact)
    sums = found.groupBy("cluster").agg(whole.alias("own")).collect()  # one row a cluster
    total = None if any(r["own"] is None for r in sums) else sum(int(r["own"]) for r in sums)
    fits = lambda x: None if x is None or x > _LONG_MAX else int(x)
    rows = [(r["cluster"], fits(r["own"]), fits(total), digest(centroids[r["cluster"]])) for r in sums]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
