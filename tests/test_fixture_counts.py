"""Row counts of the stand-in relations at sf0.001, as measured before any
implementation (FIXTURES.md section 3) and by the edge-case table (section 4)."""

import pytest

from subrecon.plans.catalog import QUERIES

EXPECTED = {
    "substitution_events_period": 3930,
    "response_events_period": 2820,
    "partner_events_period": 117,
    "clicks": 5491,
    "transactions_period": 3622,
    "products": 200,
    "click_subs": 5491,
    "click_pairs": 6008,
    "responses_in_scope": 2347,
    "partner_explained_responses": 94,
    "matched_responses": 2194,
    "responses_without_substitution": 164,
    "response_flagged": 3938,
    "reconciled": 3954,
    "unanswered": 1746,
    "recovered_from_clicks": 463,
    "answered_in_both": 517,
    "contradictions": 254,
    "contradictions_on_register": 237,
    "unanswered_on_register": 1538,
    "upc_map_ordered": 3938,
    "upc_map_picked": 3908,
    "upc_map_click": 5491,
    "upc_map_click_base": 550,
    "contradictions_found_on_register": 198,
    "unanswered_found_on_register": 1448,
    "engaged_orders": 405,
}


@pytest.mark.parametrize("name,rows", sorted(EXPECTED.items()))
def test_row_count(spark, sf_small, name, rows):
    assert QUERIES[name](spark, sf_small).count() == rows


def _metrics(df):
    return {r["metric"]: r for r in df.collect()}


def test_report_figures(fixture_rec):
    rec = fixture_rec()
    m = _metrics(rec.contradiction_matrix())
    assert m["contradictions"]["numerator"] == 254
    assert m["contradictions"]["denominator"] == 517
    assert m["accept_vs_rejected"]["numerator"] == 178
    assert m["accept_vs_rejected"]["numerator"] + m["reject_vs_accepted"]["numerator"] == 254
    s = _metrics(rec.reconciliation_summary())
    assert s["substitutions"]["numerator"] == 3930
    assert s["responses_in_scope"]["numerator"] == 2347
    assert s["matched_responses"]["numerator"] == 2194
    assert s["responses_without_substitution"]["numerator"] == 164
    assert s["partner_explained_responses"]["numerator"] == 94
    reg = _metrics(rec.contradiction_register_check())
    assert (reg["on_register_inner"]["numerator"], reg["on_register_semi"]["numerator"]) == (237, 198)
    un = _metrics(rec.unanswered_register_rate())
    assert (un["unanswered"]["numerator"], un["inferred_purchase_inner"]["numerator"],
            un["inferred_purchase_semi"]["numerator"]) == (1746, 1538, 1448)


def test_edge_cases_present(fixture_rec):
    """Section 4: the stand-ins carry the traps the tests rely on."""
    from pyspark.sql import functions as F

    rec = fixture_rec()
    r = rec.ev.response_events
    assert r.where(F.col("division").isNull()).count() == 76
    assert r.where(F.col("division") == 540).count() == 397
    c = rec.ev.clicks
    assert c.where(F.col("sub_upc").isNull()).count() == 1000
    assert c.where(F.size("sub_upc") == 0).count() == 1159
    flags = {row[0]: row[1] for row in rec.reconciled.groupBy("click_record").count().collect()}
    assert flags == {"NO": 432, "YES": 980, None: 2542}


def test_order_register_profile(fixture_rec):
    """FIXTURES.md section 4, D2: orders all / none / some on the register."""
    prof = {r["order_class"]: r["orders"] for r in fixture_rec().order_register_profile().collect()}
    assert prof == {"all": 949, "none": 40, "some": 405}
