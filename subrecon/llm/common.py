"""Helpers shared by the operators: staging, folds, byte-level tokenising."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subrecon.session import checkpoint_dir


def bounded_batches(spark: SparkSession, records: int = 2_000) -> None:
    """Smaller Arrow batches than Spark's default, unless the deployment set them: texts are long rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(records))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Cuts lineage: a lost executor costs a re-read of shared storage, not a
    recomputation of everything upstream.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/subrecon-llm/{name}-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    schema = df.schema
    back = spark.read.schema(schema).parquet(path)
    return back.select(*schema.names)


def sent_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df`` (a written table of a few narrow columns) marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null ids: null)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % folds


def by_bytes(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``limit`` bytes (one at least)."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix): spreads nearby values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each slice ``values[start:end]``, independent of its place."""
    n = len(values)
    powers = np.full(n + 1, _MULT, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(values.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    inverse = np.full(n + 1, _INV, np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    return mix64((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


#: Byte classes: words of letters, digits and everything beyond ASCII, and words between white space.
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
SPACED = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


@dataclass
class Words:
    """Words of a run of texts: byte spans in ``buf``, and of which text each is."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    count: np.ndarray

    def hashes(self, at_once: int = 1 << 17) -> np.ndarray:
        """Hash of every word, some words at a time: the sums take tens of bytes per byte of text."""
        out = np.empty(len(self.start), np.uint64)
        for lo in range(0, len(out), at_once):
            start, end = self.start[lo:lo + at_once], self.end[lo:lo + at_once]
            out[lo:lo + at_once] = span_hashes(self.buf[start[0]:end[-1]], start - start[0], end - start[0])
        return out


def words_of(texts: list[bytes], kind: np.ndarray, lower: bool = True) -> Words:
    """Split texts (UTF-8 bytes) into words of the byte class ``kind``."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        buf = LOWER[buf]
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = kind[buf]
    edges = np.diff(inside)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    text = np.searchsorted(ends, start, side="right")
    return Words(buf, start, end, text, np.bincount(text, minlength=len(texts)))
