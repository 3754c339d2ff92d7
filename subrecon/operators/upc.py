"""UPC encodings: do the feeds' UPCs exist in the product dimension?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOOKUP = ("con_upc_no", "bas_con_upc_no")


def _lookup(df: DataFrame, column: str, products: DataFrame) -> DataFrame:
    p = products.select(*LOOKUP)
    return df.join(p, df[column] == p["con_upc_no"], "inner").select(column, *LOOKUP)


def upc_map_ordered(flagged: DataFrame, products: DataFrame) -> DataFrame:
    """Flagged substitutions whose ordered UPC is a product GTIN."""
    return _lookup(flagged, "ordered_upc", products)


def upc_map_picked(flagged: DataFrame, products: DataFrame) -> DataFrame:
    """Flagged substitutions whose picked UPC is a product GTIN."""
    return _lookup(flagged, "picked_upc", products)


def upc_map_weighted(weighted: DataFrame, column: str, products: DataFrame, block: int = 100_000) -> DataFrame:
    """The lookup of ``column`` for rows that stand for ``n`` equal ones each (``flagged_weights``).

    Gives the rows of ``upc_map_ordered`` / ``upc_map_picked`` without making the flagged rows first.
    Rows of many are cut into blocks of at most ``block``, and what the lookup
    leaves is dealt out by block, so that no task writes a hot UPC's rows alone.
    """
    n = F.col("n")
    blocks = weighted.where(n > 0).withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(n / block).cast("int") - 1)))
    size = F.least(F.lit(block).cast("decimal(38,0)"), n - F.col("k") * block).cast("int")
    dealt = blocks.select(column, size.alias("size"), F.xxhash64(*blocks.columns).alias("block"))
    found = dealt.join(products.select(*LOOKUP), F.col(column) == F.col("con_upc_no"), "inner").repartition("block")
    return found.select(column, *LOOKUP, F.explode(F.sequence(F.lit(1), F.col("size"))).alias("copy")).drop("copy")


def upc_map_click(subs: DataFrame, products: DataFrame) -> DataFrame:
    """Clickstream rows whose ordered UPC is a product GTIN."""
    return _lookup(subs, "upc", products)


def upc_map_click_sub(pairs: DataFrame, products: DataFrame) -> DataFrame:
    """Exploded click pairs whose substitute UPC is a product GTIN."""
    return _lookup(pairs, "sub_upc", products)


def upc_map_click_base(subs: DataFrame, products: DataFrame) -> DataFrame:
    """Clickstream rows whose ordered UPC is some product's *base* UPC.

    The base UPC repeats across products, so an inner join would multiply
    rows; ``left_semi`` keeps each click row once, against the distinct
    base UPCs.
    """
    p = products.select("bas_con_upc_no").distinct()
    return subs.join(p, subs["upc"] == p["bas_con_upc_no"], "left_semi").select("order_id", "upc")
