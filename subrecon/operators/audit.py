"""Key fan-out audit: are the join keys the analysis relies on unique?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_KEY_WIDTH = 3


def key_fanout_audit(relations: Sequence[tuple[str, DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows, distinct keys and the largest key group, per relation.

    ``relations`` holds ``(name, frame, key columns)``. All relations are
    projected to a common ``(relation, key_columns, k1, k2, k3)`` shape
    (entries sharing a frame are generated from a single pass over it),
    unioned, counted per key (map-side partial aggregation, so a hot key is
    one row per task before the shuffle), then rolled up per relation.
    A null key value is one group, as in SQL ``GROUP BY``.
    """
    groups: dict[int, tuple[DataFrame, list]] = {}
    for name, df, keys in relations:
        if not 1 <= len(keys) <= MAX_KEY_WIDTH:
            raise ValueError(f"{name}: 1..{MAX_KEY_WIDTH} key columns expected")
        groups.setdefault(id(df), (df, []))[1].append((name, keys))
    parts = []
    for df, entries in groups.values():
        # relations over the same frame share one scan: one generated row each
        rows = []
        for name, keys in entries:
            ks = [F.col(k).cast("string") for k in keys]
            ks += [F.lit(None).cast("string")] * (MAX_KEY_WIDTH - len(keys))
            rows.append(F.struct(F.lit(name).alias("relation"), F.lit(",".join(keys)).alias("key_columns"),
                                 *[k.alias(f"k{i + 1}") for i, k in enumerate(ks)]))
        parts.append(df.select(F.explode(F.array(*rows)).alias("x")).select("x.*"))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    per_key = u.groupBy("relation", "key_columns", "k1", "k2", "k3").agg(F.count("*").alias("n"))
    return (
        per_key.groupBy("relation", "key_columns")
        .agg(
            F.sum("n").cast("bigint").alias("rows"),
            F.count("*").cast("bigint").alias("distinct_keys"),
            F.max("n").cast("bigint").alias("max_rows_per_key"),
        )
        .withColumn("duplicate_rows", F.col("rows") - F.col("distinct_keys"))
    )


def fanout_from_counts(counts: DataFrame, sources: Sequence[tuple[str, str, str]]) -> DataFrame:
    """The same audit rows from a table that already holds, per key, the
    number of rows of each relation (``sources`` = (relation, key label,
    count column)); one pass, no rescan of the relations."""
    aggs = []
    for _name, _label, c in sources:
        n = F.col(c)
        aggs += [F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(f"{c}_rows"),
                 F.count(F.when(n > 0, F.lit(1))).cast("bigint").alias(f"{c}_keys"),
                 F.max(F.when(n > 0, n)).cast("bigint").alias(f"{c}_max")]
    one = counts.agg(*aggs)
    rows = [F.struct(F.lit(name).alias("relation"), F.lit(label).alias("key_columns"),
                     F.col(f"{c}_rows").alias("rows"), F.col(f"{c}_keys").alias("distinct_keys"),
                     F.col(f"{c}_max").alias("max_rows_per_key"))
            for name, label, c in sources]
    return (one.select(F.inline(F.array(*rows)))
            .where(F.col("rows") > 0)
            .withColumn("duplicate_rows", F.col("rows") - F.col("distinct_keys")))
