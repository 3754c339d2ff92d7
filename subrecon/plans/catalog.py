"""Named queries, one per inventory item.

``BUILDERS`` maps a name to ``Reconciliation -> DataFrame`` (any inputs);
``QUERIES`` binds each to the test-data stand-ins: it takes
``(spark, sf_dir)`` and returns a lazy DataFrame over the whole of the
derived input tables (open period). Array columns are shown as
``|``-joined strings (``*_list``) so results compare as flat rows.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subrecon import operators as ops
from subrecon.functions.expressions import rounded
from subrecon.plans import job
from subrecon.plans.analysis import Reconciliation
from subrecon.session import checkpoint_dir
from subrecon.sources.fixtures import fixture_evidence
from subrecon.sources.period import OPEN, Period

Query = Callable[[SparkSession, str], DataFrame]


def _rec(spark: SparkSession, sf_dir: str) -> Reconciliation:
    return Reconciliation(fixture_evidence(spark, sf_dir, OPEN))


def _flat(df: DataFrame) -> DataFrame:
    """Replace the ``sub_upc`` array by a ``sub_upc_list`` string in place."""
    cols = [F.array_join("sub_upc", "|").alias("sub_upc_list") if c == "sub_upc" else F.col(c)
            for c in df.columns]
    return df.select(cols)


Builder = Callable[[Reconciliation], DataFrame]

BUILDERS: dict[str, Builder] = {
    # sources (S1, S3-S7), whole tables
    "substitution_events_period": lambda r: r.ev.substitution_events,
    "response_events_period": lambda r: r.ev.response_events,
    "partner_events_period": lambda r: r.ev.partner_events,
    "transactions_period": lambda r: r.ev.transactions,
    "clicks": lambda r: _flat(r.ev.clicks),
    "products": lambda r: r.ev.products,
    # clickstream side (P1, P2, G1, A1, A2)
    "click_subs": lambda r: _flat(r.click_subs),
    "click_pairs": lambda r: r.click_pairs,
    "click_channels": lambda r: ops.distinct_values(r.ev.clicks, "channel"),
    "response_statuses": lambda r: ops.statuses_of_responses(r.ev.substitution_events, r.responses),
    "click_statuses": lambda r: ops.click_statuses(r.ev.substitution_events,
                                                   ops.exploded_clicks(r.click_subs)),
    # response side (F1, P3-P5, J1-J5)
    "responses_in_scope": lambda r: r.responses,
    "partner_explained_responses":
        lambda r: ops.partner_explained_responses(r.responses, r.ev.partner_events),
    "matched_responses": lambda r: ops.matched_responses(r.ev.substitution_events, r.responses),
    "responses_right_join": lambda r: ops.responses_right_join(r.ev.substitution_events, r.responses),
    "responses_without_substitution":
        lambda r: ops.responses_without_substitution(r.ev.substitution_events, r.responses),
    "response_flagged": lambda r: r.response_flagged,
    # reconciliation (J6, P6, F3-F6)
    "reconciled": lambda r: r.reconciled,
    "unanswered": lambda r: r.unanswered,
    "recovered_from_clicks": lambda r: ops.recovered_from_clicks(r.reconciled),
    "answered_in_both": lambda r: ops.answered_in_both(r.reconciled),
    "contradictions": lambda r: r.contradictions,
    # register (J7a, J7b, D2)
    "contradictions_on_register": lambda r: ops.on_register(r.contradictions, r.ev.transactions),
    "contradictions_found_on_register": lambda r: ops.found_on_register(r.contradictions, r.ev.transactions),
    "unanswered_on_register": lambda r: ops.on_register(r.unanswered, r.ev.transactions),
    "unanswered_found_on_register": lambda r: ops.found_on_register(r.unanswered, r.ev.transactions),
    "engaged_orders": lambda r: r.engaged_orders(),
    "order_register_profile": lambda r: r.order_register_profile(),
    # product lookups (J8-J12)
    "upc_map_ordered": lambda r: ops.upc_map_weighted(r.flagged_weights, "ordered_upc", r.ev.products),
    "upc_map_picked": lambda r: ops.upc_map_weighted(r.flagged_weights, "picked_upc", r.ev.products),
    "upc_map_click": lambda r: ops.upc_map_click(r.click_subs, r.ev.products),
    "upc_map_click_base": lambda r: ops.upc_map_click_base(r.click_subs, r.ev.products),
    "upc_map_click_sub": lambda r: ops.upc_map_click_sub(r.click_pairs, r.ev.products),
    # reports (R1-R9, D1)
    "click_coverage": lambda r: r.click_coverage(),
    "response_coverage": lambda r: r.response_coverage(),
    "reconciliation_summary": lambda r: r.reconciliation_summary(),
    "recovery_rate": lambda r: r.recovery_rate(),
    "contradiction_matrix": lambda r: r.contradiction_matrix(),
    "contradiction_register_check": lambda r: r.contradiction_register_check(),
    "unanswered_register_rate": lambda r: r.unanswered_register_rate(),
    "upc_mapping_coverage": lambda r: r.upc_mapping_coverage(),
    "key_fanout_audit": lambda r: r.key_fanout_audit(),
    "period_comparison": lambda r: r.period_comparison(),
}


def _over_fixtures(build: Builder) -> Query:
    return lambda spark, sf_dir: build(_rec(spark, sf_dir))


def _in(period: Period, build: Builder) -> Query:
    return lambda spark, sf_dir: build(Reconciliation(fixture_evidence(spark, sf_dir, period)))


#: The bound is the feature: one month of each table, first and last day included.
MONTH = Period.of("1995-03-01", "1995-03-31")
#: Two given periods, not calendar months.
PAIR = (Period.of("1994-02-10", "1994-08-20"), Period.of("1995-02-10", "1995-08-20"))

#: The months that ``job_metrics`` runs, and their reports.
JOB_MONTHS = (MONTH, Period.of("1995-04-01", "1995-04-30"))
JOB_REPORTS = ("recovery_rate", "contradiction_matrix")


def job_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``metrics`` that two monthly runs of the job, the first of them repeated, have left in one output."""
    out = os.path.join(checkpoint_dir(spark), f"subrecon-output-{uuid.uuid4().hex}")
    for period in (*JOB_MONTHS, JOB_MONTHS[0]):
        job.run(spark, fixture_evidence(spark, sf_dir, period), out, reports=JOB_REPORTS)
    return spark.read.parquet(os.path.join(out, "metrics"))


BOUNDED: dict[str, Query] = {
    "job_metrics": job_metrics,
    "substitution_events_month": _in(MONTH, lambda r: r.ev.substitution_events),
    "response_events_month": _in(MONTH, lambda r: r.ev.response_events),
    "partner_events_month": _in(MONTH, lambda r: r.ev.partner_events),
    "transactions_month": _in(MONTH, lambda r: r.ev.transactions),
    "contradiction_matrix_month": _in(MONTH, lambda r: r.contradiction_matrix()),
    "reconciliation_summary_rounded": _over_fixtures(
        lambda r: r.reconciliation_summary().withColumn("percent", rounded("percent", 2))),
    "two_period_comparison": _over_fixtures(lambda r: r.compare_periods(PAIR)),
}

QUERIES: dict[str, Query] = {name: _over_fixtures(b) for name, b in BUILDERS.items()} | BOUNDED
