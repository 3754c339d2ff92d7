"""Response side: scope, and the joins of responses with substitutions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subrecon.functions.expressions import presence_flag
from subrecon.functions.values import (
    PARTNER_DIVISION,
    RESPONSE_DATE,
    RESPONSE_RECORD,
    RESPONSE_STORE,
    SUB_KEYS,
)
from subrecon.operators.joins import left_join, presence

KEYS = list(SUB_KEYS)


def evidence_keys(substitutions: DataFrame, responses: DataFrame, pairs: DataFrame) -> DataFrame:
    """Which substitution keys have a response and which a click pair, in one aggregation.

    ``pairs`` may be the exploded clicks before de-duplication: duplicate
    rows do not change whether a key has a pair.
    """
    clicks = pairs.select(F.col("order_id").alias("order_no"), F.col("upc").alias("ordered_upc"),
                          F.col("sub_upc").alias("picked_upc"))
    return presence([substitutions, responses, clicks], KEYS)


def responses_in_scope(response_events: DataFrame) -> DataFrame:
    """Responses without the partner division, store and date renamed.

    ``division <> 540`` is three-valued: rows with a *null* division are
    dropped too. ``store_code`` becomes ``cust_resp_store_code`` and
    ``event_date`` becomes ``response_date`` so the substitution side's
    columns keep their names after a join.
    """
    return (
        response_events.where(F.col("division") != PARTNER_DIVISION)
        .withColumnRenamed("store_code", RESPONSE_STORE)
        .withColumnRenamed("event_date", RESPONSE_DATE)
    )


def partner_explained_responses(responses: DataFrame, partner_events: DataFrame) -> DataFrame:
    """Responses that belong to partner-fulfilled substitutions (inner join).

    One output row per (response, partner event) pair with equal keys.
    """
    return responses.join(partner_events.select(*KEYS), KEYS, "inner")


def matched_responses(substitutions: DataFrame, responses: DataFrame) -> DataFrame:
    """Substitutions that have a response (inner join on the 3 keys)."""
    return substitutions.join(responses, KEYS, "inner")


def responses_right_join(substitutions: DataFrame, responses: DataFrame) -> DataFrame:
    """All responses, with their substitution columns if any (right join).

    Key columns carry the response side's values. Written as a left join
    from the responses that splits a hot key on either side.
    """
    subs = [c for c in substitutions.columns if c not in KEYS]
    resp = [c for c in responses.columns if c not in KEYS]
    return left_join(responses, substitutions, KEYS).select(*KEYS, *subs, *resp)


def responses_without_substitution(substitutions: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses whose key has no substitution event (``left_anti``).

    Same rows as the right join filtered on a null substitution-only
    column, without materialising the join. Only the distinct substitution
    keys are needed, so they are de-duplicated first (map-side, before the
    shuffle the join needs anyway): a hot key travels as one row per task.
    """
    return responses.join(substitutions.select(*KEYS).distinct(), KEYS, "left_anti")


def response_flagged(substitutions: DataFrame, responses: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """Every substitution with its response status, if any (left join).

    ``response_record`` is 'NO' when the joined ``status`` is null, which
    includes a matched response whose status itself is null. A key with
    several responses yields several rows. A hot key is split whichever side
    it is hot on. ``sides`` is an ``evidence_keys`` to share with ``reconciled``.
    """
    return (
        left_join(substitutions.select(*KEYS, "store_code"), responses.select(*KEYS, "status"), KEYS, sides=sides)
        .withColumn(RESPONSE_RECORD, presence_flag("status"))
        .select(*KEYS, "status", RESPONSE_RECORD, "store_code")
    )
