"""Clickstream side: column selection, answer flag, explode, de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subrecon.functions.expressions import presence_flag
from subrecon.functions.values import CLICK_RECORD

DEAL = "__deal"


def click_subs(clicks: DataFrame, extras: Sequence[str] = ()) -> DataFrame:
    """Clickstream rows narrowed to the substitution columns, with a flag.

    Keeps every column whose name contains ``sub`` (case-sensitive, in input
    order), then ``upc``, ``order_id`` and ``click_record`` ('YES' when
    ``sub_status`` is present, else 'NO'), then ``extras`` (e.g. a period
    column for grouped runs). Column pruning reaches the Parquet scan.
    """
    cols = [c for c in clicks.columns if "sub" in c]
    cols += ["upc", "order_id", CLICK_RECORD]
    cols += [e for e in extras if e not in cols]
    return clicks.withColumn(CLICK_RECORD, presence_flag("sub_status")).select(cols)


def exploded_clicks(subs: DataFrame) -> DataFrame:
    """One row per substitute UPC, before de-duplication (``explode``)."""
    return subs.withColumn("sub_upc", F.explode(F.col("sub_upc")))


def click_pairs(subs: DataFrame) -> DataFrame:
    """One row per substitute UPC, whole-row de-duplicated.

    ``explode`` (not ``explode_outer``): rows whose ``sub_upc`` array is null
    or empty produce nothing; a null element yields a row that never joins.
    De-duplication is over *all* columns, so the same
    ``(order_id, upc, sub_upc)`` can remain more than once when another
    carried column differs (see ``key_fanout_audit``). Equal pairs come from
    clicks that are equal in every other column, so the clicks are dealt out by a hash of those
    and exploded where they meet: a click moves once however many substitutes it has, and no map
    task holds a table of nearly distinct rows, which it would spill. A click repeated
    without end meets in one task, which keeps one row of it.
    """
    others = [c for c in subs.columns if c != "sub_upc"]
    dealt = subs.where(F.size("sub_upc") > 0).withColumn(DEAL, F.hash(*others)).repartition(DEAL)
    return exploded_clicks(dealt).dropDuplicates().drop(DEAL)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of one column (what the analysis eyeballs first)."""
    return df.select(column).distinct()
