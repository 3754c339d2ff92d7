"""Outer joins whose hot keys Spark can split on either side.

AQE splits a hot partition only on the preserved side of an outer join, so a
hot key on the other side would stay in one task. A left join is therefore
written as two inner joins, of which either side is split: with the right side, and
with the keys that the right side lacks (``missing``). Which keys those are comes from one
aggregation over both sides' keys (``presence``), where a hot key is one row per task.
Both joins compare keys null-safely, so they deal the left side alike, and Spark
shuffles it once and reuses that exchange.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SIDES = "__sides"


def presence(sides: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row per key of any of ``sides``, with a bit in ``__sides`` for each side that has it.

    One aggregation over the union, pre-aggregated map-side. Keys with a null part
    match nothing: only the first side's (bit 0) are counted.
    """
    tagged = [d.select(*keys, F.lit(1 << k).alias(SIDES)) for k, d in enumerate(sides)]
    whole = [tagged[0], *[t.dropna(subset=list(keys)) for t in tagged[1:]]]
    return reduce(DataFrame.unionByName, whole).groupBy(*keys).agg(F.bit_or(SIDES).alias(SIDES))


def missing(sides: DataFrame, keys: Sequence[str], bit: int = 1) -> DataFrame:
    """The keys of side 0 that side ``bit`` of a ``presence`` lacks, those with a null part among them."""
    return sides.where(F.col(SIDES).bitwiseAND(F.lit(1 | 1 << bit)) == 1).select(*keys)


def left_join(left: DataFrame, right: DataFrame, keys: Sequence[str], own_shuffle: bool = False,
              sides: DataFrame | None = None, bit: int = 1, mark: str | None = None) -> DataFrame:
    """``left.join(right, keys, "left")``: keys, left columns, right columns.

    Null keys match nothing, as in the join. Column names other than the
    keys must be on one side only. ``sides`` is a ``presence`` that already holds the left keys
    (bit 0) and the right keys (``bit``), for joins that share one. ``own_shuffle`` is for a ``left`` that is
    itself a join on the same keys: Spark would chain the two without a shuffle
    between them, and could not split a key that is hot only in ``right``. Joining on
    a hash of the keys too makes it deal ``left`` out anew; the hash is worked out on either side of
    the shuffle and does not travel. ``mark`` names a last column that tells rows with a partner.
    """
    keys = list(keys)
    if sides is None:
        sides, bit = presence([left, right], keys), 1
    own = [c for c in left.columns if c not in keys]
    others = [f for f in right.schema.fields if f.name not in keys]
    right, lacking = right.dropna(subset=keys), missing(sides, keys, bit)
    on: list[Column] = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    if own_shuffle:
        on.insert(0, F.xxhash64(*[F.col(f"l.{k}") for k in keys]) == F.xxhash64(*[F.col(f"r.{k}") for k in keys]))
    met = lambda yes: [F.lit(yes).alias(mark)] if mark else []

    def joined(side: DataFrame, *columns: Column) -> DataFrame:
        return left.alias("l").join(side.alias("r"), reduce(Column.__and__, on), "inner").select(
            *[f"l.{c}" for c in (*keys, *own)], *columns)

    return joined(right, *[F.col(f"r.{f.name}") for f in others], *met(True)).unionByName(
        joined(lacking, *[F.lit(None).cast(f.dataType).alias(f.name) for f in others], *met(False)))
