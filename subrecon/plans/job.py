"""Batch job: read one period's inputs, write every report as Parquet.

    spark-submit --py-files subrecon.zip reconcile_job.py \
        --input <dir> --output <dir> --start 2024-02-01 --end 2024-02-29

The click pairs, the per-key count table and the register table derived from
it feed several reports, so they are written once to the shared folder named
by ``spark.checkpoint.dir`` and read back: that cuts the lineage, so a lost
executor costs a re-read, not a re-run of the scans and shuffles. Every
report is then one small job. Row-level relations (unanswered, contradictions with their
``contradiction_class``, ...) are written only with ``--relations``. The
``metrics`` table gathers the long-format reports with a 2-decimal
``percent_rounded`` for display.

Each output table is a folder with one partition ``run_period=<period>`` a period: runs of
several periods share one output, and a rerun replaces its own partition only, also where it
has no rows left (which a dynamic partition overwrite would leave as they were). Reading the
table's folder gives the rows of all runs.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subrecon import operators as ops
from subrecon.functions.expressions import answer_class, rounded
from subrecon.plans.analysis import Reconciliation
from subrecon.session import checkpoint_dir, delete_folder, input_bytes, prepare_for_skew, size_shuffle
from subrecon.sources.period import Period, month_of
from subrecon.sources.tables import Evidence, table_paths

log = logging.getLogger(__name__)

LONG_REPORTS = ("reconciliation_summary", "recovery_rate", "contradiction_matrix",
                "contradiction_register_check", "unanswered_register_rate", "upc_mapping_coverage")
FLAG_REPORTS = ("click_coverage", "response_coverage")
REGISTER_REPORTS = ("contradiction_register_check", "unanswered_register_rate", "engaged_orders", "order_register_profile")
TABLE_REPORTS = ("engaged_orders", "order_register_profile", "key_fanout_audit", "period_comparison")


PARTITION = "run_period"


def _write(df: DataFrame, output: str, name: str, period: Period, mode: str, single_file: bool = False) -> str:
    """Write the run's partition of an output table; returns its path."""
    path = f"{output.rstrip('/')}/{name}/{PARTITION}={period.folder}"
    (df.coalesce(1) if single_file else df).write.mode(mode).parquet(path)
    return path


def materialize(spark: SparkSession, df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Write ``df`` to ``path`` (shared storage) and return the re-read table."""
    df.write.mode(mode).parquet(path)
    return spark.read.parquet(path)


def run(spark: SparkSession, ev: Evidence, output: str, *, relations: bool = False,
        reports: Sequence[str] | None = None, mode: str = "overwrite") -> dict[str, str]:
    """Compute and write the reports; returns ``{name: path}``, the run's partition of each table.

    Only the stage tables that the wanted outputs share are built, in a
    folder of this run below the checkpoint folder, which is removed at the end, whether the run succeeds or
    fails. The clicks are exploded and de-duplicated once.
    """
    stages = os.path.join(checkpoint_dir(spark), f"subrecon-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}")
    try:
        return _run(spark, ev, output, stages, relations, reports, mode)
    finally:
        delete_folder(spark, stages)


def _run(spark: SparkSession, ev: Evidence, output: str, stages: str, relations: bool,
         reports: Sequence[str] | None, mode: str) -> dict[str, str]:
    rec = Reconciliation(ev)
    wanted = set(reports) if reports else set(LONG_REPORTS + FLAG_REPORTS + TABLE_REPORTS)
    undated = "event_date" not in ev.clicks.columns
    if "period_comparison" in wanted and undated and not ev.period.month:
        log.warning("period_comparison is left out: the clicks have no event_date, and %s is not one month",
                    ev.period.label())
        wanted.discard("period_comparison")
    monthly = "period_comparison" in wanted and not ev.period.month
    counted = bool(wanted - {"click_coverage"} - ({"period_comparison"} if monthly else set()))
    stage = lambda name, df: materialize(spark, df, os.path.join(stages, name), mode)
    written: dict[str, str] = {}
    if monthly:
        clicks = ops.click_subs(ev.clicks.withColumn("period", month_of("event_date")), extras=["period"])
        pairs = stage("click_pairs", ops.click_pairs(clicks))
        rec.pairs_by_period = pairs.where("period IS NOT NULL")
        rec.click_pairs = pairs.drop("period").dropDuplicates()
    elif counted or relations:
        rec.click_pairs = stage("click_pairs", rec.click_pairs)
    if relations:  # from the staged pairs, not from the clicks again
        rec.evidence_keys = ops.evidence_keys(ev.substitution_events, rec.responses, rec.click_pairs)
    if counted:
        rec.with_stats(stage("key_stats", rec.stats))
    if wanted & set(REGISTER_REPORTS):
        rec.register = stage("register", rec.register)

    long_frames = []
    for name in LONG_REPORTS + FLAG_REPORTS + TABLE_REPORTS:
        if name not in wanted:
            continue
        df = getattr(rec, name)()
        written[name] = _write(df, output, name, ev.period, mode,
                               single_file=name not in ("engaged_orders", "period_comparison"))
        if name in LONG_REPORTS:
            long_frames.append(spark.read.parquet(written[name]).select(F.lit(name).alias("report"), "*"))
    if long_frames:
        metrics = long_frames[0]
        for f in long_frames[1:]:
            metrics = metrics.unionByName(f)
        metrics = metrics.withColumn("percent_rounded", rounded("percent", 2))
        written["metrics"] = _write(metrics.withColumn("period", F.lit(ev.period.label())), output, "metrics", ev.period,
                                    mode, single_file=True)

    if relations:
        rec.reconciled = stage("reconciled", rec.reconciled)
        rel = {
            "reconciled": rec.reconciled,
            "response_flagged": rec.response_flagged,
            "answered_in_both": ops.answered_in_both(rec.reconciled),
            "recovered_from_clicks": ops.recovered_from_clicks(rec.reconciled),
            "upc_map_ordered": ops.upc_map_weighted(rec.flagged_weights, "ordered_upc", ev.products),
            "upc_map_picked": ops.upc_map_weighted(rec.flagged_weights, "picked_upc", ev.products),
            "upc_map_click": ops.upc_map_click(rec.click_subs, ev.products),
            "upc_map_click_base": ops.upc_map_click_base(rec.click_subs, ev.products),
            "upc_map_click_sub": ops.upc_map_click_sub(rec.click_pairs, ev.products),
            "click_channels": ops.distinct_values(ev.clicks, "channel"),
            "response_statuses": ops.statuses_of_responses(ev.substitution_events, rec.responses),
            "click_statuses": ops.distinct_values(rec.reconciled, "sub_status"),
            "unanswered": rec.unanswered,
            "contradictions": rec.contradictions.withColumn("contradiction_class", answer_class()),
            "contradictions_on_register": ops.on_register(rec.contradictions, ev.transactions),
            "unanswered_on_register": ops.on_register(rec.unanswered, ev.transactions),
            "responses_without_substitution": ops.responses_without_substitution(
                ev.substitution_events, rec.responses),
        }
        for name, df in rel.items():
            written[f"relations/{name}"] = _write(df, os.path.join(output, "relations"), name, ev.period, mode)
    return written


def main(argv: Sequence[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--input", help="directory with one Parquet folder per input table")
    src.add_argument("--fixtures", help="driver test-data directory (stand-in inputs)")
    ap.add_argument("--output", required=True)
    ap.add_argument("--start")
    ap.add_argument("--end")
    ap.add_argument("--relations", action="store_true")
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName("subrecon").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # period bounds on timestamps are UTC days
    prepare_for_skew(spark)
    period = Period.of(args.start, args.end)
    if args.input:
        ev = Evidence.read(spark, args.input, period)
        size_shuffle(spark, input_bytes(spark, list(table_paths(spark, args.input).values())))
    else:
        from subrecon.sources.fixtures import fixture_evidence
        ev = fixture_evidence(spark, args.fixtures, period)
    print(json.dumps(run(spark, ev, args.output, relations=args.relations), indent=1))


if __name__ == "__main__":
    main()
