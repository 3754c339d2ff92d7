
from pyspark.sql import functions as F

from helpers import click, evidence, metrics, partner, resp, sub, txn
from subrecon import operators as ops
from subrecon.plans.analysis import Reconciliation


def test_t1_null_division_dropped_with_partner_division(spark):
    ev = evidence(spark, resps=[resp("1", "a", "b", division=None), resp("1", "a", "c", division=540),
                                resp("1", "a", "d", division=7)])
    out = ops.responses_in_scope(ev.response_events)
    assert [r["picked_upc"] for r in out.collect()] == ["d"]
    assert "cust_resp_store_code" in out.columns and "store_code" not in out.columns


def test_t2_explode_drops_null_and_empty_keeps_null_element(spark):
    ev = evidence(spark, clicks=[click("1", "a", None), click("1", "b", []), click("1", "c", ["x", None])],
                  subs=[sub("1", "c", None)])
    pairs = ops.click_pairs(ops.click_subs(ev.clicks))
    from collections import Counter
    assert Counter((r["upc"], r["sub_upc"]) for r in pairs.collect()) == Counter([("c", None), ("c", "x")])
    rec = Reconciliation(ev)
    # the null element never joins the substitution whose picked UPC is null
    assert rec.reconciled.where(F.col("click_record").isNotNull()).count() == 0


def test_t3_same_triple_two_statuses_survives_distinct(spark):
    ev = evidence(spark, clicks=[click("1", "a", ["b"], "accepted"), click("1", "a", ["b"], "rejected"),
                                 click("1", "a", ["b"], "accepted")])
    pairs = ops.click_pairs(ops.click_subs(ev.clicks))
    assert pairs.count() == 2
    audit = {r["relation"]: r for r in Reconciliation(ev).key_fanout_audit().collect()}
    assert audit["click_pairs"]["duplicate_rows"] == 1
    assert audit["click_pairs"]["max_rows_per_key"] == 2


def test_t4_duplicate_response_key_multiplies_rows(spark):
    ev = evidence(spark, subs=[sub("1", "a", "b")],
                  resps=[resp("1", "a", "b", "Accept"), resp("1", "a", "b", "Reject")])
    rec = Reconciliation(ev)
    assert rec.response_flagged.count() == 2
    cov = {r["response_record"]: (r["count"], r["total"], r["percent"]) for r in rec.response_coverage().collect()}
    assert cov == {"YES": (2, 1, 200.0)}


def test_t5_anti_join_equals_right_join_null_test(spark):
    ev = evidence(spark, subs=[sub("1", "a", "b")], resps=[resp("1", "a", "b"), resp("2", "a", "b")])
    rec = Reconciliation(ev)
    anti = ops.responses_without_substitution(ev.substitution_events, rec.responses)
    right = ops.responses_right_join(ev.substitution_events, rec.responses).where(
        F.col("attempted_utilization").isNull())
    assert [r["order_no"] for r in anti.collect()] == ["2"] == [r["order_no"] for r in right.collect()]


def test_t6_matched_response_with_null_status_is_unanswered(spark):
    ev = evidence(spark, subs=[sub("1", "a", "b")], resps=[resp("1", "a", "b", status=None)])
    rec = Reconciliation(ev)
    assert [r["response_record"] for r in rec.response_flagged.collect()] == ["NO"]
    assert metrics(rec.recovery_rate())["recovered_from_clicks"][1] == 1


def test_t7_click_flag_has_three_states(spark):
    ev = evidence(spark,
                  subs=[sub("1", "a", "b"), sub("2", "a", "b"), sub("3", "a", "b")],
                  clicks=[click("1", "a", ["b"], None), click("2", "a", ["b"], "accepted")])
    flags = {r["order_no"]: r["click_record"] for r in Reconciliation(ev).reconciled.collect()}
    assert flags == {"1": "NO", "2": "YES", "3": None}


def test_t8_other_status_lands_in_other(spark):
    ev = evidence(spark, subs=[sub("1", "a", "b"), sub("2", "a", "b")],
                  resps=[resp("1", "a", "b", "Maybe"), resp("2", "a", "b", "Accept")],
                  clicks=[click("1", "a", ["b"], "rejected"), click("2", "a", ["b"], "rejected")])
    m = metrics(Reconciliation(ev).contradiction_matrix())
    assert m["contradictions"][:2] == (1, 2)
    assert m["other"][:2] == (1, 2)
    assert m["accept_vs_rejected"] == (1, 1, 100.0)


def test_t9_zero_denominators_give_null_percent(spark):
    ev = evidence(spark)
    rec = Reconciliation(ev)
    m = metrics(rec.contradiction_matrix())
    assert m["contradictions"] == (0, 0, None)
    assert rec.click_coverage().count() == 0
    assert metrics(rec.recovery_rate())["recovered_from_clicks"] == (0, 0, None)


def test_t12_two_register_lines_inner_vs_semi(spark):
    ev = evidence(spark, subs=[sub("1", "a", "b", store="S1")],
                  txns=[txn("1", "b", "S1"), txn("1", "b", "S1"), txn("1", "b", "S2")])
    rec = Reconciliation(ev)
    assert ops.on_register(rec.unanswered, ev.transactions).count() == 2
    assert ops.found_on_register(rec.unanswered, ev.transactions).count() == 1
    m = metrics(rec.unanswered_register_rate())
    assert m["inferred_purchase_inner"][:2] == (2, 1)
    assert m["inferred_purchase_semi"][:2] == (1, 1)
    assert m["inferred_purchase_inner"][2] == 200.0


def test_null_keys_never_match(spark):
    ev = evidence(spark, subs=[sub("1", "a", None)], resps=[resp("1", "a", None)],
                  partners=[partner("1", "a", None)], txns=[txn("1", None)])
    rec = Reconciliation(ev)
    s = metrics(rec.reconciliation_summary())
    assert s["matched_responses"][0] == 0
    assert s["responses_without_substitution"][0] == 1
    assert s["partner_explained_responses"][0] == 0
    assert s["substitutions_without_response"][0] == 1
    assert metrics(rec.unanswered_register_rate())["inferred_purchase_inner"][0] == 0


def test_null_ordered_upc_still_reaches_register(spark):
    """The register key does not use the ordered UPC."""
    ev = evidence(spark, subs=[sub(None, "a", "b")] + [sub("1", None, "b")], txns=[txn("1", "b")])
    m = metrics(Reconciliation(ev).unanswered_register_rate())
    assert m["unanswered"][0] == 2
    assert m["inferred_purchase_semi"][0] == 1


def test_partner_has_sub_filter(spark):
    ev = evidence(spark, partners=[partner("1", "a", "b", True), partner("2", "a", "b", False)])
    assert [r["order_no"] for r in ev.partner_events.collect()] == ["1"]


def test_engaged_orders_some_not_all(spark):
    ev = evidence(spark,
                  subs=[sub("1", "a", "b"), sub("1", "a", "c"), sub("2", "a", "b"), sub("3", "a", "b")],
                  txns=[txn("1", "b"), txn("2", "b")])
    rows = [(r["order_no"], r["substitutions"], r["on_register"]) for r in
            Reconciliation(ev).engaged_orders().collect()]
    assert rows == [("1", 2, 1)]


def test_click_subs_selects_sub_columns_in_order(spark):
    ev = evidence(spark, clicks=[click("1", "a", ["b"])])
    cols = ops.click_subs(ev.clicks).columns
    assert cols == ["sub_upc", "sub_status", "sub_price", "upc", "order_id", "click_record"]


def test_upc_lookups(spark):
    from helpers import PRODUCTS  # noqa: F401

    ev = evidence(spark, subs=[sub("1", "0010", "0011")],
                  clicks=[click("1", "0010", ["0011", "0099"]), click("2", "0020", [])],
                  products=[("0010", "0010"), ("0011", "0010"), ("0012", "0010"), ("0020", "0020")])
    rec = Reconciliation(ev)
    m = metrics(rec.upc_mapping_coverage())
    assert m["ordered_upc_gtin"][:2] == (1, 1)
    assert m["picked_upc_gtin"][:2] == (1, 1)
    assert m["click_upc_gtin"][:2] == (2, 2)
    assert m["click_upc_base"][:2] == (2, 2)      # base UPC repeats, semi join counts once
    assert m["click_sub_upc_gtin"][:2] == (1, 2)
    assert ops.upc_map_click_base(rec.click_subs, ev.products).count() == 2


def test_period_with_clicks_only_still_reported(spark):
    import datetime as dt

    ev = evidence(spark, subs=[sub("1", "a", "b", d=dt.date(2024, 2, 3))],
                  clicks=[click("1", "a", ["b"], "accepted", d=dt.date(2024, 3, 5)),
                          click("2", "a", ["b"], None, d=dt.date(2024, 3, 6))])
    rows = {r["period"]: r for r in Reconciliation(ev).period_comparison().collect()}
    assert set(rows) == {"2024-02", "2024-03"}
    assert (rows["2024-03"]["substitutions"], rows["2024-03"]["clicks"],
            rows["2024-03"]["clicks_with_answer"], rows["2024-03"]["pct_clicks_with_answer"]) == (0, 2, 1, 50.0)
    assert (rows["2024-02"]["substitutions"], rows["2024-02"]["clicks"], rows["2024-02"]["unanswered"]) == (1, 0, 1)
    assert rows["2024-02"]["pct_clicks_with_answer"] is None


def test_click_pairs_equal_exploded_distinct_rows(spark):
    """Clicks that differ only in their substitutes, repeat one, or hold odd numbers give every distinct pair once."""
    nan = float("nan")
    rows = [click("1", "a", ["b", "b", None]), click("1", "a", ["b", "c"]), click("1", "a", ["c"], price=2.0),
            click("1", "a", ["b"], price=0.0), click("1", "a", ["b"], price=-0.0), click("1", "a", ["d"], price=nan),
            click("1", "a", ["d"], price=nan), click(None, None, ["b"], None), click(None, None, ["b"], None),
            click("2", "a", []), click("2", "a", None)] * 3
    subs = ops.click_subs(evidence(spark, clicks=rows).clicks, extras=["event_date"])
    pairs = ops.click_pairs(subs)
    assert pairs.columns == ops.exploded_clicks(subs).columns
    want = ops.exploded_clicks(subs).distinct()
    assert sorted(map(repr, pairs.collect())) == sorted(map(repr, want.collect())) and pairs.count() == 7
