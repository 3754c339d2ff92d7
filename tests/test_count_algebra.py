"""Reports computed from per-key counts equal brute-force row-level counts.

Random small inputs (small key domains so keys repeat, null keys, null and
unknown statuses, null/empty arrays and null elements, duplicate rows);
the row-level relations are the plain joins of the analysis, counted in
Spark, and the register / engaged-order figures are also checked in Python.
"""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpers import click, evidence, metrics, partner, resp, sub, txn
from subrecon import operators as ops
from subrecon.plans.analysis import Reconciliation
from subrecon.sources.period import Period
from subrecon.sources.tables import Evidence

import datetime as dt


def _pick(rng, xs, null=0.1):
    return None if rng.random() < null else rng.choice(xs)


def random_inputs(seed):
    rng = random.Random(seed)
    orders, upcs, stores = ["1", "2", "3"], ["a", "b", "c"], ["S1", "S2"]
    days = [dt.date(2024, 1, 15), dt.date(2024, 2, 10)]
    subs = [sub(_pick(rng, orders), _pick(rng, upcs), _pick(rng, upcs), _pick(rng, stores),
                d=rng.choice(days)) for _ in range(rng.randint(5, 30))]
    resps = [resp(_pick(rng, orders), _pick(rng, upcs), _pick(rng, upcs),
                  _pick(rng, ["Accept", "Reject", "Maybe"], 0.15), _pick(rng, [1, 2, 540], 0.1),
                  d=rng.choice(days)) for _ in range(rng.randint(5, 30))]
    partners = [partner(_pick(rng, orders), _pick(rng, upcs), _pick(rng, upcs), rng.random() < 0.8,
                        d=rng.choice(days)) for _ in range(rng.randint(0, 8))]
    clicks = []
    for _ in range(rng.randint(5, 30)):
        n = rng.choice([None, 0, 1, 2, 3])
        arr = None if n is None else [_pick(rng, upcs, 0.05) for _ in range(n)]
        c = click(_pick(rng, orders), _pick(rng, upcs), arr,
                  _pick(rng, ["accepted", "rejected", "pending"], 0.3), price=float(rng.randint(1, 2)),
                  d=rng.choice(days))
        clicks.append(c)
        if rng.random() < 0.2:
            clicks.append(c)
    txns = [txn(_pick(rng, orders), _pick(rng, upcs), rng.choice(stores), d=rng.choice(days))
            for _ in range(rng.randint(0, 20))]
    products = [(u, "a") for u in upcs[:2]] + [("b", "b")]
    return subs, resps, partners, clicks, txns, products


@pytest.mark.parametrize("seed", range(4))
def test_reports_equal_row_level_counts(spark, seed):
    subs, resps, partners, clicks, txns, products = random_inputs(seed)
    ev = evidence(spark, subs, resps, partners, clicks, txns, products)
    rec = Reconciliation(ev)
    S, Rr = ev.substitution_events, rec.responses

    s = metrics(rec.reconciliation_summary())
    assert s["substitutions"][0] == S.count()
    assert s["responses_in_scope"][0] == Rr.count()
    assert s["matched_responses"][0] == ops.matched_responses(S, Rr).count()
    assert s["responses_without_substitution"][0] == ops.responses_without_substitution(S, Rr).count()
    assert s["partner_explained_responses"][0] == ops.partner_explained_responses(
        Rr, ev.partner_events).count()
    flagged = rec.response_flagged
    assert s["substitutions_without_response"][0] == flagged.where("response_record = 'NO'").count()

    cov = {r["response_record"]: r["count"] for r in rec.response_coverage().collect()}
    assert cov == {k: v for k, v in
                   Counter(r["response_record"] for r in flagged.collect()).items()}

    rc = rec.reconciled
    assert metrics(rec.recovery_rate())["recovered_from_clicks"][:2] == (
        ops.recovered_from_clicks(rc).count(), ops.unanswered(rc).count())

    m = metrics(rec.contradiction_matrix())
    both = ops.answered_in_both(rc)
    assert m["contradictions"][:2] == (ops.contradictions(rc).count(), both.count())
    assert m["accept_vs_rejected"][0] == both.where(
        "status = 'Accept' AND sub_status = 'rejected'").count()
    assert m["reject_vs_rejected"][0] == both.where(
        "status = 'Reject' AND sub_status = 'rejected'").count()

    con = rec.contradictions
    reg = metrics(rec.contradiction_register_check())
    assert reg["on_register_inner"][0] == ops.on_register(con, ev.transactions).count()
    assert reg["on_register_semi"][0] == ops.found_on_register(con, ev.transactions).count()
    un = rec.unanswered
    reg = metrics(rec.unanswered_register_rate())
    assert reg["unanswered"][0] == un.count()
    assert reg["inferred_purchase_inner"][0] == ops.on_register(un, ev.transactions).count()
    assert reg["inferred_purchase_semi"][0] == ops.found_on_register(un, ev.transactions).count()

    u = metrics(rec.upc_mapping_coverage())
    assert u["ordered_upc_gtin"][:2] == (ops.upc_map_ordered(flagged, ev.products).count(), flagged.count())
    assert u["picked_upc_gtin"][0] == ops.upc_map_picked(flagged, ev.products).count()
    assert u["click_upc_gtin"][0] == ops.upc_map_click(rec.click_subs, ev.products).count()
    assert u["click_upc_base"][0] == ops.upc_map_click_base(rec.click_subs, ev.products).count()
    assert u["click_sub_upc_gtin"][:2] == (
        ops.upc_map_click_sub(rec.click_pairs, ev.products).count(), rec.click_pairs.count())

    # engaged orders, brute force in Python
    tx = {(t[0], t[1], t[2]) for t in txns if None not in t[:3]}
    per = {}
    for o, _u, p, st, _x, _d in subs:
        hit = (o, p, st) in tx
        a, b = per.get(o, (0, 0))
        per[o] = (a + 1, b + hit)
    want = sorted((o, n, h) for o, (n, h) in per.items() if 0 < h < n)
    got = sorted((r["order_no"], r["substitutions"], r["on_register"])
                 for r in rec.engaged_orders().collect())
    assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_period_comparison_equals_runs_per_month(spark, seed):
    subs, resps, partners, clicks, txns, products = random_inputs(seed)
    ev = evidence(spark, subs, resps, partners, clicks, txns, products)
    table = {r["period"]: r for r in Reconciliation(ev).period_comparison().collect()}
    for period, (start, end) in {"2024-01": ("2024-01-01", "2024-01-31"),
                                 "2024-02": ("2024-02-01", "2024-02-29")}.items():
        one = Reconciliation(ev.with_period(Period.of(start, end)))
        s = metrics(one.reconciliation_summary())
        m = metrics(one.contradiction_matrix())
        r = metrics(one.recovery_rate())
        row = table.get(period)
        got = (0,) * 6 if row is None else (
            row["substitutions"], row["matched_responses"], row["without_response"],
            row["responses_without_substitution"], row["contradictions"], row["unanswered"])
        want = (s["substitutions"][0], s["matched_responses"][0], s["substitutions_without_response"][0],
                s["responses_without_substitution"][0], m["contradictions"][0],
                r["recovered_from_clicks"][1])
        assert got == want, period
        clicks_in = one.ev.clicks
        if row is not None:
            assert row["clicks"] == clicks_in.count()
            assert row["clicks_with_answer"] == clicks_in.where(F.col("sub_status").isNotNull()).count()


@pytest.mark.parametrize("seed", range(4))
def test_distinct_statuses_equal_reconciled(spark, seed):
    subs, resps, partners, clicks, txns, products = random_inputs(seed)
    rec = Reconciliation(evidence(spark, subs, resps, partners, clicks, txns, products))
    rc = rec.reconciled
    want_s = {r[0] for r in rc.select("status").distinct().collect()}
    want_c = {r[0] for r in rc.select("sub_status").distinct().collect()}
    assert {r[0] for r in ops.response_statuses(rec.response_flagged).collect()} == want_s
    assert {r[0] for r in ops.click_statuses(rec.ev.substitution_events, rec.click_pairs).collect()} == want_c
    exploded = ops.exploded_clicks(rec.click_subs)
    assert {r[0] for r in ops.click_statuses(rec.ev.substitution_events, exploded).collect()} == want_c


def test_counts_beyond_bigint_products_stay_exact(spark):
    """Three million rows of one key in each source: 2.7e19 reconciled rows."""
    from subrecon.plans import reports as R
    from subrecon.plans.stats import COUNTS, totals

    n = 3_000_000
    row = dict.fromkeys(COUNTS, n) | {"r_null": 0, "c_null": 0}
    stats = spark.createDataFrame([("1", "a", "b", None, *[row[c] for c in COUNTS])],
                                  "order_no string, ordered_upc string, picked_upc string, null_side string, "
                                  + ", ".join(f"{c} bigint" for c in COUNTS))
    t = totals(stats, ["reconciled_rows", "contradictions", "matched_responses"]).first()
    assert (int(t["reconciled_rows"]), int(t["contradictions"]), int(t["matched_responses"])) == (n**3, 2 * n**3, n**2)
    assert metrics(R.reconciliation_summary(stats))["matched_responses"][0] == n**2
    with pytest.raises(Exception, match="metric .*exceeds BIGINT"):
        R.contradiction_matrix(stats).collect()


def test_one_key_holding_every_row_of_all_four_sources(spark):
    from pyspark.sql import functions as F

    n = 60_000
    base = spark.range(n)
    key = [F.lit("1").alias("order_no"), F.lit("a").alias("ordered_upc"), F.lit("b").alias("picked_upc")]
    day = F.lit("2024-02-10").cast("date")
    ev = Evidence.from_frames({
        "substitution_events": base.select(*key, F.lit("S").alias("store_code"), F.lit(0.5).alias("attempted_utilization"),
                                           day.alias("event_date")),
        "response_events": base.select(*key, F.lit("S").alias("store_code"), F.lit("Accept").alias("status"),
                                       F.lit(1).cast("bigint").alias("division"), day.alias("event_date")),
        "partner_events": base.select(*key, F.lit(True).alias("has_sub"), day.alias("event_date")),
        "clicks": base.select(F.lit("1").alias("order_id"), F.lit("a").alias("upc"), F.array(F.lit("b")).alias("sub_upc"),
                              F.lit("rejected").alias("sub_status"), F.lit("app").alias("channel"),
                              F.col("id").cast("double").alias("sub_price"), day.alias("event_date")),
        "transactions": base.select(F.lit("1").alias("order_no"), F.lit("b").alias("gtin_no"), F.lit("S").alias("store_code"),
                                    day.alias("transaction_date")),
        "products": spark.createDataFrame([("b", "b")], "con_upc_no string, bas_con_upc_no string"),
    })
    from subrecon.plans.stats import totals

    rec = Reconciliation(ev)
    assert metrics(rec.contradiction_matrix())["contradictions"][0] == n**3
    reg = rec.register.first()
    assert int(reg["contra_rows"]) == n**3 and reg["lines"] == n
    with pytest.raises(Exception, match="on_register_inner.*exceeds BIGINT"):
        rec.contradiction_register_check().collect()  # 60000^4 = 1.3e19 rows are more than BIGINT holds
    assert int(totals(rec.stats, ["contradictions"]).first()[0]) == n**3
