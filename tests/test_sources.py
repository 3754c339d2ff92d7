"""Contracts, loaders and periods."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from helpers import RESP, SUBS, click, evidence, resp, sub
from subrecon.sources.contracts import ContractError
from subrecon.sources.period import Period
from subrecon.sources.tables import TABLES, Evidence, read_table, scope


def test_missing_column_fails_early(spark):
    df = spark.createDataFrame([sub("1", "a", "b")], SUBS).drop("picked_upc")
    with pytest.raises(ContractError, match="picked_upc"):
        scope("substitution_events", df)


def test_wrong_type_fails_early(spark):
    df = spark.createDataFrame([resp("1", "a", "b")], RESP).withColumn("division", F.col("division").cast("string"))
    with pytest.raises(ContractError, match="division"):
        scope("response_events", df)


def test_sub_upc_must_be_string_array(spark):
    ev = evidence(spark, clicks=[click("1", "a", ["b"])])
    bad = ev.clicks.withColumn("sub_upc", F.col("sub_upc").getItem(0))
    with pytest.raises(ContractError, match="sub_upc"):
        scope("clicks", bad)


def test_period_bounds_inclusive(spark):
    days = [dt.date(2024, 1, 31), dt.date(2024, 2, 1), dt.date(2024, 2, 29), dt.date(2024, 3, 1)]
    ev = evidence(spark, subs=[sub(str(i), "a", "b", d=d) for i, d in enumerate(days)],
                  period=Period.of("2024-02-01", "2024-02-29"))
    assert sorted(r["order_no"] for r in ev.substitution_events.collect()) == ["1", "2"]


def test_period_on_timestamps_keeps_whole_last_day(spark):
    df = spark.createDataFrame([sub("1", "a", "b")], SUBS).withColumn(
        "event_date", F.lit("2024-02-29 23:59:59").cast("timestamp_ntz"))
    out = scope("substitution_events", df, Period.of("2024-02-01", "2024-02-29"))
    assert out.count() == 1


def test_period_rejects_reversed_bounds():
    with pytest.raises(ValueError):
        Period.of("2024-03-01", "2024-02-01")


def test_read_from_parquet_pushes_period_into_scan(spark):
    d = tempfile.mkdtemp(prefix="subrecon-src-")
    ev = evidence(spark, subs=[sub("1", "a", "b"), sub("2", "a", "b", d=dt.date(2023, 8, 3))])
    for t in TABLES:
        getattr(ev, t).write.parquet(os.path.join(d, t))
    period = Period.of("2023-08-01", "2023-08-31")
    loaded = Evidence.read(spark, d, period)
    assert [r["order_no"] for r in loaded.substitution_events.collect()] == ["2"]
    plan = loaded.substitution_events.select("order_no")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(event_date" in plan
    assert "LessThan(event_date" in plan
    one = read_table(spark, "transactions", os.path.join(d, "transactions"), period)
    assert one.count() == 0


def test_parallel_sub_array_rejected(spark):
    ev = evidence(spark, clicks=[click("1", "a", ["b"])])
    bad = ev.clicks.withColumn("sub_price_list", F.array(F.col("sub_price")))
    with pytest.raises(ContractError, match="pairing"):
        scope("clicks", bad)


def test_unpinned_sub_column_is_kept(spark):
    from subrecon import operators as ops

    ev = evidence(spark, clicks=[click("1", "a", ["b"])])
    extra = scope("clicks", ev.clicks.withColumn("sub_flavour", F.lit("x")))
    assert "sub_flavour" in ops.click_subs(extra).columns


def test_period_comparison_needs_click_dates(spark):
    from subrecon.plans.analysis import Reconciliation
    from subrecon.sources.tables import Evidence

    ev = evidence(spark, clicks=[click("1", "a", ["b"])])
    frames = {t: getattr(ev, t) for t in TABLES}
    frames["clicks"] = frames["clicks"].drop("event_date")
    with pytest.raises(ContractError, match="event_date"):
        Reconciliation(Evidence.from_frames(frames)).period_comparison()


def test_table_paths_ask_sparks_file_system(spark, tmp_path):
    """Both layouts, below a path that only the file system object resolves."""
    from subrecon.sources.tables import table_paths

    ev = evidence(spark)
    for t in TABLES:
        getattr(ev, t).write.parquet(str(tmp_path / (t if t == "clicks" else f"{t}.parquet")))
    for base in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        paths = table_paths(spark, base)
        assert paths["clicks"] == f"{base}/clicks" and paths["products"] == f"{base}/products.parquet"
        assert Evidence.read(spark, base).clicks.count() == 0
