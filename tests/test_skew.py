"""One hot key holding most rows of every source.

Materialising the joins would give n^2 (matched) and n^3 (reconciled)
rows; the reports must still be exact and cheap, because they are sums
of per-key products computed after map-side pre-aggregation.
"""

import pytest

from helpers import click, evidence, metrics, resp, sub, txn
from subrecon.plans.analysis import Reconciliation

N = 2000


def test_hot_key_reports_are_exact_without_fanout(spark):
    hot = ("1", "a", "b")
    subs = [sub(*hot, store="S1")] * N + [sub("2", "a", "b", store="S1")]
    resps = [resp(*hot, "Accept" if i % 2 else "Reject") for i in range(N)]
    # distinct prices keep the click rows distinct through the whole-row de-duplication
    clicks = [click("1", "a", ["b"], "accepted" if i % 4 else "rejected", price=float(i)) for i in range(N)]
    txns = [txn("1", "b", "S1")] * N
    ev = evidence(spark, subs, resps, (), clicks, txns)
    rec = Reconciliation(ev)
    s = metrics(rec.reconciliation_summary())
    assert s["matched_responses"][0] == N * N
    m = metrics(rec.contradiction_matrix())
    accept, reject = N // 2, N // 2
    accepted, rejected = N - N // 4, N // 4
    assert m["contradictions"][:2] == (N * (accept * rejected + reject * accepted), N * N * N)
    r = metrics(rec.recovery_rate())
    assert r["recovered_from_clicks"][:2] == (0, 1)      # only the cold substitution is unanswered
    reg = metrics(rec.contradiction_register_check())
    contra = N * (accept * rejected + reject * accepted)
    assert reg["on_register_inner"][:2] == (contra * N, contra)  # every row x every register line
    assert reg["on_register_semi"][:2] == (contra, contra)


SKEW_TEST_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


HOT_ROWS, COLD_ROWS = 12_000, 24_000
HOT = ("hot", "a", "b")


def _hot_inputs(hot: str):
    """A third of one source's rows share a key; every source also has cold keys."""
    n = COLD_ROWS
    subs = [sub(str(i), "a", "b", store=f"S{i % 50}", util=i * 1.37) for i in range(n)]
    resps = [resp(str(i), "a", "b", "Accept", store=f"S{i % 50}") for i in range(0, n, 2)]
    clicks = [click(str(i), "a", ["b"], "rejected", price=float(i)) for i in range(0, n, 2)]
    subs += [sub(*HOT, store=f"S{i}", util=i * 1.37) for i in range(HOT_ROWS if hot == "substitutions" else 2)]
    resps += [resp(*HOT, "Accept", store=f"S{i}") for i in range(HOT_ROWS if hot == "responses" else 2)]
    clicks += [click("hot", "a", ["b"], "rejected", price=float(i)) for i in range(HOT_ROWS if hot == "clicks" else 2)]
    return subs, resps, clicks


#: relation -> (sides that may be hot in it, its rows of the hot key for a hot side)
RELATIONS = {
    "response_flagged": ("substitutions", "responses"),
    "responses_right_join": ("substitutions", "responses"),
    "reconciled": ("substitutions", "responses", "clicks"),
    "contradictions": ("substitutions", "responses", "clicks"),
    "unanswered": ("substitutions",),
}


@pytest.mark.parametrize("name, hot", [(n, h) for n, sides in RELATIONS.items() for h in sides])
def test_row_level_joins_split_a_hot_key(spark, name, hot):
    """AQE splits a hot key on any side (tiny thresholds stand in for cluster-size ones)."""
    from subrecon import operators as ops

    subs, resps, clicks = _hot_inputs(hot)
    if name == "unanswered":
        resps = [r for r in resps if r[0] != "hot"]
    old = {k: spark.conf.get(k, None) for k in SKEW_TEST_CONF}
    try:
        for k, v in SKEW_TEST_CONF.items():
            spark.conf.set(k, v)
        rec = Reconciliation(evidence(spark, subs, resps, (), clicks))
        frames = {"responses_right_join": lambda: ops.responses_right_join(rec.ev.substitution_events, rec.responses)}
        qe = frames.get(name, lambda: getattr(rec, name))()._jdf.queryExecution()
        rows = qe.toRdd().count()
        plan = qe.executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan, plan
        if name in ("reconciled", "contradictions"):
            cold = COLD_ROWS if name == "reconciled" else COLD_ROWS // 2
            assert rows == HOT_ROWS * 2 * 2 + cold
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_prepare_for_skew_keeps_explicit_settings(spark):
    from subrecon.session import prepare_for_skew

    key = "spark.sql.adaptive.forceOptimizeSkewedJoin"
    old = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "false")
        assert key not in prepare_for_skew(spark)
        assert spark.conf.get(key) == "false"
        spark.conf.unset(key)
        assert prepare_for_skew(spark).get(key) == "true"
        assert spark.conf.get(key) == "true"
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)
