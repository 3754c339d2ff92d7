"""Period figures: one shuffle of the evidence, and every figure equal to that of a run of one period."""

import datetime as dt
import re

import pytest
from pyspark.sql import types as T

from helpers import CLICKS, click, evidence, metrics, partner, resp, sub, txn
from subrecon import operators as ops
from subrecon.plans import period_stats as P
from subrecon.plans.analysis import Reconciliation
from subrecon.sources.period import Period

JAN, FEB = dt.date(2024, 1, 31), dt.date(2024, 2, 1)


def _figures(rec):
    """Register and UPC figures of a run of one period, under their names in the period table."""
    u, c, n = metrics(rec.upc_mapping_coverage()), metrics(rec.contradiction_register_check()), metrics(rec.unanswered_register_rate())
    s, m, r = metrics(rec.reconciliation_summary()), metrics(rec.contradiction_matrix()), metrics(rec.recovery_rate())
    return {
        "substitutions": s["substitutions"][0], "responses_in_scope": s["responses_in_scope"][0],
        "matched_responses": s["matched_responses"][0], "partner_explained_responses": s["partner_explained_responses"][0],
        "without_response": s["substitutions_without_response"][0], "answered_in_both": m["contradictions"][1],
        "contradictions": m["contradictions"][0], "accept_vs_rejected": m["accept_vs_rejected"][0],
        "reject_vs_accepted": m["reject_vs_accepted"][0],
        "unanswered": r["recovered_from_clicks"][1], "recovered_from_clicks": r["recovered_from_clicks"][0],
        "contradictions_on_register": c["on_register_inner"][0], "contradictions_found_on_register": c["on_register_semi"][0],
        "unanswered_on_register": n["inferred_purchase_inner"][0], "unanswered_found_on_register": n["inferred_purchase_semi"][0],
        "response_flagged_rows": u["ordered_upc_gtin"][1], "click_pairs": u["click_sub_upc_gtin"][1],
        "clicks": u["click_upc_gtin"][1], "ordered_upc_mapped": u["ordered_upc_gtin"][0],
        "picked_upc_mapped": u["picked_upc_gtin"][0], "click_upc_mapped": u["click_upc_gtin"][0],
        "click_upc_base_mapped": u["click_upc_base"][0], "click_sub_upc_mapped": u["click_sub_upc_gtin"][0],
    }


def test_every_figure_equals_a_run_of_one_month(spark):
    hot = [sub("9", "a", "b", store=f"S{i % 3}", d=FEB) for i in range(300)]
    ev = evidence(
        spark,
        subs=[*hot, sub("1", "a", "b", d=JAN), sub("1", "a", "b", d=FEB), sub("1", "a", "b", store="S2", d=FEB), sub("1", "c", "b", d=FEB),
              sub(None, "a", "b", d=FEB), sub("1", None, "b", d=FEB), sub("1", "a", None, d=FEB), sub("2", "a", "b", store=None, d=FEB),
              sub("3", "a", "x", d=None), sub("4", "a", "b", d=FEB)],
        resps=[*[resp("9", "a", "b", "Accept" if i % 2 else "Reject", d=FEB) for i in range(270)], resp("1", "a", "b", d=JAN),
               resp("1", "a", "b", "Reject", d=FEB), resp("1", "a", "b", None, d=FEB), resp("1", None, "b", d=FEB), resp("4", "a", "b", "?", d=FEB),
               resp("7", "a", "b", d=FEB)],
        partners=[partner("1", "a", "b", d=FEB), partner(None, "a", "b", d=FEB), partner("7", "a", "b", d=FEB)],
        clicks=[*[click("9", "a", ["b"], "rejected", price=float(i), d=FEB) for i in range(260)],
                click("1", "a", ["b", "b", None], d=FEB), click("1", "a", ["b", "c"], d=FEB), click("1", "a", ["b", "b", None], d=FEB),
                click("1", "a", ["b"], None, d=JAN), click("1", "a", None, d=FEB), click("1", "a", [], None, d=FEB), click("1", "a", [], None, d=FEB),
                click(None, None, ["b"], d=FEB), click("1", "c", ["b"], "other", d=FEB), click("1", "a", ["b"], price=-0.0, d=FEB),
                click("1", "a", ["b"], price=0.0, d=FEB), click("1", "a", ["b"], d=None)],
        txns=[txn("9", "b", "S0", d=FEB), txn("9", "b", "S0", d=FEB), txn("9", "b", "S1", d=FEB), txn("1", "b", d=FEB), txn("1", "b", "S2", d=JAN),
              txn(None, "b", d=FEB), txn("2", "b", None, d=FEB), txn("4", "b", d=FEB), txn("4", "b", d=None)],
        products=[("a", "b"), ("b", "b"), ("b", "z"), ("c", None), (None, "a")])
    table = {r["period"]: r for r in Reconciliation(ev).period_comparison().collect()}
    assert set(table) == {"2024-01", "2024-02"}
    given = {r["period"]: r for r in Reconciliation(ev).compare_periods(
        [Period.of(FEB, "2024-02-29"), Period.of(JAN, JAN), Period.of(FEB, "2024-02-10")]).collect()}
    assert set(given) == {"2024-02-01/2024-02-29", "2024-01-31/2024-01-31", "2024-02-01/2024-02-10"}
    for month, label, period in (("2024-01", "2024-01-31/2024-01-31", Period.of("2024-01-01", "2024-01-31")),
                                 ("2024-02", "2024-02-01/2024-02-10", Period.of("2024-02-01", "2024-02-29"))):
        want = _figures(Reconciliation(ev.with_period(period)))
        assert {n: table[month][n] for n in want} == want
        assert {n: given[label][n] for n in want} == want


def test_clicks_told_apart_by_which_column_is_null(spark):
    """A fingerprint of values alone would skip nulls and take these for one click."""
    schema = T.StructType([*CLICKS.fields, T.StructField("sub_a", T.StringType()), T.StructField("sub_b", T.StringType()),
                           T.StructField("sub_list", T.ArrayType(T.StringType()))])
    rows = [(*click("1", "a", ["b"]), *x) for x in [("v", None, ["p"]), (None, "v", ["p"]), ("v", "", ["p"]), ("v", None, ["p", None]),
                                                    ("v", None, None), ("v", None, ["p"]), ("v", None, [])]]
    clicks = spark.createDataFrame(rows, schema)
    counted = P.dated_evidence(*[_empty(spark, d) for d in ("s", "r", "p")], clicks.selectExpr("*", "1 AS period"), "period")
    assert counted.count() == ops.click_pairs(ops.click_subs(clicks)).count() == 6
    assert counted.groupBy().sum("k").first()[0] == len(rows)


def _empty(spark, which):
    ev = evidence(spark)
    df = {"s": ev.substitution_events, "r": ops.responses_in_scope(ev.response_events), "p": ev.partner_events}[which]
    return df.selectExpr("*", "1 AS period")


def test_evidence_is_shuffled_once(spark, fixture_rec, tmp_path):
    """Totals, register and UPC figures read one exchange of narrow rows; only register keys and UPCs move again."""
    qe = fixture_rec().period_comparison()._jdf.queryExecution()
    qe.toRdd().count()
    plan = qe.executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 2, plan
    plan = re.sub(r"\bReusedExchange.*", "", plan)
    assert len(re.findall(r"\bExchange (?:hashpartitioning|SinglePartition|RoundRobin)", plan)) <= 7, plan
    assert len(re.findall(r"\bExchange hashpartitioning\(pmod\(hash\(order_no", plan)) == 1, plan


@pytest.mark.parametrize("day", ["0999-12-31", "1970-01-01", "1969-12-31", "2024-02-29", "9999-12-31"])
def test_month_numbers_name_their_month(spark, day):
    from subrecon.sources.period import month_name, month_number, month_of

    df = spark.sql(f"SELECT DATE'{day}' AS d").withColumn("n", month_number("d"))
    row = df.select(month_name("n").alias("name"), month_of("d").alias("want")).first()
    assert row["name"] == row["want"]
