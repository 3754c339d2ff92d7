"""Attach clickstream answers to flagged substitutions and slice the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subrecon.functions.expressions import is_contradiction, presence_flag
from subrecon.functions.values import CLICK_CARRIED, CLICK_RECORD, NO, RESPONSE_RECORD, SUB_KEYS, YES
from subrecon.operators.joins import left_join

LEAD_COLUMNS = (RESPONSE_RECORD, CLICK_RECORD, "order_no", "ordered_upc", "picked_upc",
                "sub_upc", "status", "sub_status", "store_code")


def reconciled(flagged: DataFrame, pairs: DataFrame, by: Sequence[str] = (),
               sides: DataFrame | None = None) -> DataFrame:
    """Left join of flagged substitutions with exploded click pairs.

    Keys: order_no = order_id, ordered_upc = upc, picked_upc = sub_upc
    (plus ``by`` columns present on both sides, for grouped runs). After the
    join ``click_record`` has three states: 'YES', 'NO', or null when no
    click row matched. Output: the two flags, the keys, both answers,
    the substitution's store, the carried click attributes (those present),
    then ``by``. A hot key is split whichever side it is hot on. ``sides`` is the ``evidence_keys``
    that ``flagged`` was made with, if any: its click bit then tells which keys have no click.
    The flags, and ``sub_upc``, which a match has equal to ``picked_upc``, are set after the join, so that no shuffle carries them.
    """
    carried = [c for c in CLICK_CARRIED if c in pairs.columns]
    clicks = pairs.select(
        F.col("order_id").alias("order_no"), F.col("upc").alias("ordered_upc"), F.col("sub_upc").alias("picked_upc"),
        *by, "sub_status", *carried)
    left = flagged.select(*SUB_KEYS, *by, "status", "store_code")
    met = F.col("__met")
    return left_join(left, clicks, [*SUB_KEYS, *by], own_shuffle=True, sides=sides, bit=2, mark="__met").withColumns({
        RESPONSE_RECORD: presence_flag("status"), CLICK_RECORD: F.when(met, presence_flag("sub_status")),
        "sub_upc": F.when(met, F.col("picked_upc"))}).select(*LEAD_COLUMNS, *carried, *by)


def unanswered(rec: DataFrame) -> DataFrame:
    """Reconciled rows without a response answer."""
    return rec.where(F.col(RESPONSE_RECORD) == NO)


def recovered_from_clicks(rec: DataFrame) -> DataFrame:
    """Unanswered rows that have an answer in the clickstream."""
    return rec.where((F.col(RESPONSE_RECORD) == NO) & (F.col(CLICK_RECORD) == YES))


def answered_in_both(rec: DataFrame) -> DataFrame:
    """Rows answered by the response feed and by the clickstream."""
    return rec.where((F.col(RESPONSE_RECORD) == YES) & (F.col(CLICK_RECORD) == YES))


def contradictions(rec: DataFrame) -> DataFrame:
    """Answered-in-both rows whose two answers are opposite."""
    return answered_in_both(rec).where(is_contradiction())


def response_statuses(flagged: DataFrame) -> DataFrame:
    """Distinct response ``status`` values of the reconciled rows.

    The click join keeps every flagged row, so these are exactly the
    distinct statuses of the flagged rows: no click data is needed.
    """
    return flagged.select("status").distinct()


def statuses_of_responses(substitutions: DataFrame, responses: DataFrame) -> DataFrame:
    """``response_statuses`` without the flagged rows.

    The statuses of responses whose key is some substitution's, plus null when some substitution has
    no response: one left join of the distinct substitution keys with the distinct (key, ``status``), where
    a hot key is one row a status.
    """
    keys = list(SUB_KEYS)
    return substitutions.select(*keys).distinct().join(
        responses.select(*keys, "status").distinct(), keys, "left").select("status").distinct()


def click_statuses(substitutions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distinct clickstream ``sub_status`` values of the reconciled rows.

    One left join of the distinct substitution keys with the distinct
    (key, ``sub_status``) of the click pairs: the statuses of pairs whose key
    is some substitution's, plus null when some substitution has none. Same
    set as selecting it from ``reconciled``, without emitting its join rows;
    a hot key is one row a status before the join. ``pairs`` may be the exploded clicks before de-duplication: duplicate
    rows change neither a set of values nor whether a key has a pair.
    """
    keys = list(SUB_KEYS)
    subs = substitutions.select(*keys).distinct()
    pk = pairs.select(F.col("order_id").alias("order_no"), F.col("upc").alias("ordered_upc"),
                      F.col("sub_upc").alias("picked_upc"), "sub_status").distinct()
    return subs.join(pk, keys, "left").select("sub_status").distinct()
