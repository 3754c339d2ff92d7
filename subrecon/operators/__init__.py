"""Row-level relational operators of the reconciliation (DataFrame -> DataFrame)."""

from subrecon.operators.audit import fanout_from_counts, key_fanout_audit
from subrecon.operators.clicks import click_pairs, click_subs, distinct_values, exploded_clicks
from subrecon.operators.reconcile import (
    answered_in_both,
    click_statuses,
    contradictions,
    reconciled,
    recovered_from_clicks,
    response_statuses,
    statuses_of_responses,
    unanswered,
)
from subrecon.operators.register import (
    engaged_orders,
    found_on_register,
    on_register,
    order_register_counts,
    order_register_profile,
    orders_from_register,
    register_counts,
)
from subrecon.operators.responses import (
    evidence_keys,
    matched_responses,
    partner_explained_responses,
    response_flagged,
    responses_in_scope,
    responses_right_join,
    responses_without_substitution,
)
from subrecon.operators.upc import (
    upc_map_click,
    upc_map_click_base,
    upc_map_click_sub,
    upc_map_ordered,
    upc_map_picked,
    upc_map_weighted,
)

__all__ = [
    "answered_in_both", "click_pairs", "click_statuses", "click_subs", "contradictions", "distinct_values",
    "engaged_orders", "evidence_keys", "exploded_clicks", "fanout_from_counts", "found_on_register", "key_fanout_audit", "matched_responses",
    "on_register", "order_register_counts", "order_register_profile", "orders_from_register",
    "partner_explained_responses", "reconciled", "recovered_from_clicks",
    "register_counts", "response_flagged", "response_statuses", "responses_in_scope", "responses_right_join",
    "responses_without_substitution", "statuses_of_responses", "unanswered", "upc_map_click", "upc_map_click_base",
    "upc_map_click_sub", "upc_map_ordered", "upc_map_picked", "upc_map_weighted",
]
