"""Register (point-of-sale) confirmation of substitutions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _register_cond():
    return [
        F.col("d.order_no") == F.col("t.order_no"),
        F.col("d.picked_upc") == F.col("t.gtin_no"),
        F.col("d.store_code") == F.col("t.store_code"),
    ]


def on_register(df: DataFrame, transactions: DataFrame) -> DataFrame:
    """Rows of ``df`` joined to register lines of the same order, store and
    picked UPC (inner join).

    A product rung up on several lines multiplies the row, so the count can
    exceed the input's; ``found_on_register`` gives the row-true set. The
    register side's duplicate ``order_no`` / ``store_code`` are dropped;
    ``gtin_no`` and ``transaction_date`` are kept. A hit shows a purchase,
    not an acceptance: the item may have been bought separately.
    """
    t = transactions.select("order_no", "gtin_no", "store_code", "transaction_date").alias("t")
    d = df.alias("d")
    return d.join(t, _register_cond(), "inner").select("d.*", "t.gtin_no", "t.transaction_date")


def found_on_register(df: DataFrame, transactions: DataFrame) -> DataFrame:
    """Rows of ``df`` that have at least one register line (``left_semi``).

    The register side is reduced to distinct keys first (map-side partial
    aggregation; its output is already partitioned for the join).
    """
    t = transactions.select("order_no", "gtin_no", "store_code").distinct().alias("t")
    return df.alias("d").join(t, _register_cond(), "left_semi")


def order_register_counts(substitutions: DataFrame, transactions: DataFrame) -> DataFrame:
    """Per order: substitutions, and how many of them are on the register.

    A substitution is found when a register line has its order, store and
    picked UPC. Both inputs are reduced to one row per register key by a
    single aggregation over their union (map-side partial aggregation
    collapses a hot order before the shuffle), then rolled up per order.
    No join, no per-order collection.
    """
    keyed = register_counts(substitutions.select(
        "order_no", F.col("picked_upc").alias("gtin_no"), "store_code",
        F.lit(1).cast("bigint").alias("subs")), transactions)
    return orders_from_register(keyed)


def orders_from_register(keyed: DataFrame) -> DataFrame:
    """Roll a per-register-key table (``subs``, ``lines``) up per order."""
    return keyed.groupBy("order_no").agg(
        F.sum("subs").cast("bigint").alias("substitutions"),
        F.sum(F.when(F.col("lines") > 0, F.col("subs")).otherwise(F.lit(0))).cast("bigint")
        .alias("on_register"),
    ).where(F.col("substitutions") > 0)


def engaged_orders(per_order: DataFrame) -> DataFrame:
    """Orders where some, but not all, substitutions are on the register.

    Orders where all or none are found are typical of customers who accept
    or reject everything blindly; the rest are "engaged". ``per_order`` is
    ``order_register_counts`` (or ``orders_from_register``) output.
    """
    return per_order.where((F.col("on_register") > 0) & (F.col("on_register") < F.col("substitutions")))


def order_register_profile(per_order: DataFrame) -> DataFrame:
    """Orders by how many of their substitutions are on the register:
    ``all``, ``none`` or ``some`` (the engaged ones), with order and
    substitution counts per class. ``per_order`` as for ``engaged_orders``."""
    cls = (F.when(F.col("on_register") == F.col("substitutions"), F.lit("all"))
           .when(F.col("on_register") == 0, F.lit("none"))
           .otherwise(F.lit("some")))
    return per_order.groupBy(cls.alias("order_class")).agg(
        F.count("*").cast("bigint").alias("orders"),
        F.sum("substitutions").cast("bigint").alias("substitutions"),
        F.sum("on_register").cast("bigint").alias("on_register"),
    )


def register_counts(weighted: DataFrame, transactions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per register key: summed weights of ``weighted`` and register lines.

    ``weighted`` has ``order_no, gtin_no, store_code`` and numeric weight
    columns. Register lines with a null key can never join, so they are
    dropped; weighted rows with a null key stay and get ``lines = 0``.
    ``by`` columns of both inputs are part of the key.
    """
    keys = ["order_no", "gtin_no", "store_code", *by]
    weights = {f.name: f.dataType for f in weighted.schema.fields if f.name not in keys}
    t = (
        transactions.where(F.col("order_no").isNotNull() & F.col("gtin_no").isNotNull()
                           & F.col("store_code").isNotNull())
        .select(*keys,
                *[F.lit(0).cast(kind).alias(w) for w, kind in weights.items()],
                F.lit(1).cast("bigint").alias("lines"))
    )
    w = weighted.withColumn("lines", F.lit(0).cast("bigint"))
    return (
        w.unionByName(t)
        .groupBy(*keys)
        .agg(*[F.sum(c).cast(kind).alias(c) for c, kind in weights.items()], F.sum("lines").cast("bigint").alias("lines"))
    )
