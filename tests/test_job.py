"""The batch job writes every report and matches the lazy reports."""

import os

import pytest

from helpers import metrics
from subrecon.plans import job
from subrecon.plans.analysis import Reconciliation
from subrecon.sources.fixtures import fixture_evidence


def test_job_writes_reports(spark, sf_small, tmp_path):
    out = str(tmp_path / "reports")
    ev = fixture_evidence(spark, sf_small)
    written = job.run(spark, ev, out, relations=True)
    for name in job.LONG_REPORTS + job.FLAG_REPORTS + job.TABLE_REPORTS + ("metrics",):
        assert os.path.isdir(written[name]), name
    ckpt = spark.conf.get("spark.checkpoint.dir")
    assert not [d for d in os.listdir(ckpt) if d.startswith("subrecon-local")]  # the run's stage folder is gone
    assert spark.read.parquet(written["relations/reconciled"]).count() == Reconciliation(ev).reconciled.count()
    for name in ("response_flagged", "answered_in_both", "recovered_from_clicks", "upc_map_click_sub", "click_statuses"):
        assert os.path.isdir(written[f"relations/{name}"])
    m = spark.read.parquet(written["metrics"])
    assert set(r["report"] for r in m.select("report").distinct().collect()) == set(job.LONG_REPORTS)
    cm = metrics(spark.read.parquet(written["contradiction_matrix"]))
    assert cm == metrics(Reconciliation(ev).contradiction_matrix())
    contra = spark.read.parquet(written["relations/contradictions"])
    assert contra.count() == 254
    classes = {r[0]: r[1] for r in contra.groupBy("contradiction_class").count().collect()}
    assert classes == {"accept_vs_rejected": 178, "reject_vs_accepted": 76}
    pr = {r["metric"]: r["percent_rounded"] for r in m.where("report = 'contradiction_matrix'").collect()}
    assert pr["contradictions"] == round(254 / 517 * 100, 2)


def test_job_cli_over_fixtures(spark, sf_small, tmp_path):
    out = str(tmp_path / "cli")
    job.main(["--fixtures", sf_small, "--output", out, "--start", "1996-01-01", "--end", "1996-12-31"])
    rows = spark.read.parquet(os.path.join(out, "metrics")).collect()
    assert rows and all(r["period"] == "1996-01-01/1996-12-31" for r in rows)


def test_size_shuffle_respects_explicit_settings(spark):
    from subrecon.session import size_shuffle

    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    # the test session sets spark.sql.shuffle.partitions explicitly: left alone
    assert size_shuffle(spark, 10 << 40) is None
    assert spark.conf.get(key, None) is None


def test_input_bytes(spark, tmp_path):
    from subrecon.session import input_bytes

    p = tmp_path / "t"
    spark.range(100).write.parquet(str(p))
    assert input_bytes(spark, [str(p)]) > 0
    with pytest.raises(Exception, match="missing"):
        input_bytes(spark, [str(p), str(tmp_path / "missing")])


def test_size_shuffle_has_no_cap(spark):
    from subrecon.session import size_shuffle

    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        assert size_shuffle(spark, 10**14) == 372_530
    finally:
        spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_materialized_reports_equal_lazy_ones(spark, sf_small, tmp_path):
    """With the count tables materialised, the audit and the per-order
    reports are derived from them; results must not change."""
    from subrecon.plans.job import materialize

    ev = fixture_evidence(spark, sf_small)
    lazy = Reconciliation(ev)
    mat = Reconciliation(ev)
    mat.with_stats(materialize(spark, mat.stats, str(tmp_path / "ks")))
    mat.register = materialize(spark, mat.register, str(tmp_path / "reg"))

    from collections import Counter

    def rows(df):
        return Counter(tuple(r) for r in df.select(sorted(df.columns)).collect())

    for name in ("key_fanout_audit", "engaged_orders", "order_register_profile", "contradiction_matrix",
                 "upc_mapping_coverage", "unanswered_register_rate"):
        assert rows(getattr(mat, name)()) == rows(getattr(lazy, name)()), name


def test_single_month_comparison_from_materialised_counts(spark, sf_small, tmp_path):
    from collections import Counter

    from subrecon.plans.job import materialize
    from subrecon.sources.period import Period

    ev = fixture_evidence(spark, sf_small, Period.of("1996-03-01", "1996-03-31"))
    lazy = Reconciliation(ev).period_comparison()
    mat = Reconciliation(ev)
    mat.with_stats(materialize(spark, mat.stats, str(tmp_path / "ks")))
    derived = mat.period_comparison()

    def rows(df):
        return Counter(tuple(r) for r in df.select(sorted(df.columns)).collect())

    assert rows(derived) == rows(lazy)
    assert rows(derived)  # the month has data


def test_job_cli_over_parquet_inputs(spark, sf_small, tmp_path):
    from subrecon.sources.fixtures import fixture_frames

    inputs = tmp_path / "in"
    for name, df in fixture_frames(spark, sf_small).items():
        df.write.parquet(str(inputs / name))
    out = str(tmp_path / "out")
    job.main(["--input", str(inputs), "--output", out])
    cm = metrics(spark.read.parquet(os.path.join(out, "contradiction_matrix")))
    assert cm["contradictions"][:2] == (254, 517)


def _undated(ev):
    from subrecon.sources.tables import TABLES, Evidence

    frames = {t: getattr(ev, t) for t in TABLES}
    frames["clicks"] = frames["clicks"].drop("event_date")
    return Evidence.from_frames(frames, ev.period)


def test_one_month_of_undated_clicks_writes_every_report(spark, sf_small, tmp_path):
    from subrecon.sources.period import Period

    ev = _undated(fixture_evidence(spark, sf_small, Period.of("1996-03-01", "1996-03-31")))
    written = job.run(spark, ev, str(tmp_path / "out"))
    assert set(job.LONG_REPORTS + job.FLAG_REPORTS + job.TABLE_REPORTS + ("metrics",)) <= set(written)
    row = spark.read.parquet(written["period_comparison"]).collect()
    lazy = Reconciliation(ev)
    m = metrics(lazy.contradiction_matrix())
    assert len(row) == 1 and row[0]["period"] == "1996-03"
    assert (row[0]["contradictions"], row[0]["answered_in_both"]) == m["contradictions"][:2]
    assert row[0]["unanswered"] == metrics(lazy.recovery_rate())["recovered_from_clicks"][1]
    assert row[0] == lazy.period_comparison().collect()[0]


def test_months_of_undated_clicks_leave_the_comparison_out(spark, sf_small, tmp_path, caplog):
    written = job.run(spark, _undated(fixture_evidence(spark, sf_small)), str(tmp_path / "out"))
    assert set(job.LONG_REPORTS + job.FLAG_REPORTS + ("key_fanout_audit", "metrics")) <= set(written)
    assert "period_comparison" not in written and "no event_date" in caplog.text


def test_a_run_explodes_the_clicks_once(spark, sf_small, tmp_path, monkeypatch):
    """Every written plan, over the whole run: one explode of the click arrays."""
    plans = []
    real = job._write, job.materialize

    def keep(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])

    monkeypatch.setattr(job, "_write", lambda df, *a, **k: (keep(df), real[0](df, *a, **k))[1])
    monkeypatch.setattr(job, "materialize", lambda s, df, *a, **k: (keep(df), real[1](s, df, *a, **k))[1])
    job.run(spark, fixture_evidence(spark, sf_small), str(tmp_path / "out"), relations=True)
    assert sum(p.count("Generate explode(sub_upc") for p in plans) == 1


def test_one_report_builds_no_stage(spark, sf_small, tmp_path, monkeypatch):
    monkeypatch.setattr(job, "materialize", lambda *a, **k: pytest.fail("a stage was built"))
    written = job.run(spark, fixture_evidence(spark, sf_small), str(tmp_path / "out"), reports=["click_coverage"])
    assert set(written) == {"click_coverage"}


def test_two_months_share_one_output(spark, sf_small, tmp_path):
    """A run replaces its own partition only; the table's folder has the rows of both."""
    from subrecon.sources.period import Period

    out = str(tmp_path / "shared")
    months = [Period.of("1995-03-01", "1995-03-31"), Period.of("1995-04-01", "1995-04-30")]

    def run(period):
        job.run(spark, fixture_evidence(spark, sf_small, period), out,
                reports=("contradiction_matrix", "period_comparison", "order_register_profile"))
        return {t: sorted(map(tuple, spark.read.parquet(f"{out}/{t}").collect()), key=repr)
                for t in ("contradiction_matrix", "period_comparison", "order_register_profile", "metrics")}

    first, both, again = run(months[0]), run(months[1]), run(months[0])
    assert both == again
    for t, rows in first.items():
        assert rows and set(rows) < set(both[t]), t
    assert {r["run_period"] for r in spark.read.parquet(f"{out}/metrics").collect()} == {p.folder for p in months}
    # a rerun that has no rows left leaves none behind
    empty = fixture_evidence(spark, sf_small, months[0])
    from dataclasses import replace
    empty = replace(empty, substitution_events=empty.substitution_events.limit(0), transactions=empty.transactions.limit(0))
    job.run(spark, empty, out, reports=("order_register_profile",))
    assert {r["run_period"] for r in spark.read.parquet(f"{out}/order_register_profile").collect()} == {months[1].folder}


def test_stages_are_removed_when_a_run_fails(spark, sf_small, tmp_path, monkeypatch):
    def fail(*args, **kwargs):
        raise RuntimeError("no room")

    monkeypatch.setattr(job, "_write", fail)
    with pytest.raises(RuntimeError, match="no room"):
        job.run(spark, fixture_evidence(spark, sf_small), str(tmp_path / "x"), reports=("recovery_rate",))
    assert not [d for d in os.listdir(spark.conf.get("spark.checkpoint.dir")) if d.startswith("subrecon-local")]
