"""Summarise the physical plan of every catalog query (markdown table).

Runs each query's own plan once over staged stand-in inputs (so scans are
real Parquet scans), then counts the operators of the final adaptive plan:
exchanges, joins by strategy, aggregates, generators, and the Parquet
scans' pushed filters. Broadcast is left to AQE at its default threshold,
or, with ``--no-broadcast``, off: the plans that large inputs get.

    python tools/plan_summary.py /root/testdata/sf0.01 [--no-broadcast]
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import stage_inputs  # noqa: E402
from subrecon.plans.analysis import Reconciliation  # noqa: E402
from subrecon.plans.catalog import BUILDERS  # noqa: E402
from subrecon.session import local_session  # noqa: E402
from subrecon.sources.tables import Evidence  # noqa: E402

OPS = [
    ("shuffles", r"\bExchange hashpartitioning|\bExchange SinglePartition|\bExchange RoundRobin"),
    ("smj", r"\bSortMergeJoin\b"),
    ("bhj", r"\bBroadcastHashJoin\b"),
    ("shj", r"\bShuffledHashJoin\b"),
    ("aggregates", r"\bHashAggregate\b|\bObjectHashAggregate\b|\bSortAggregate\b"),
    ("explode", r"\bGenerate explode"),
    ("scans", r"\bFileScan parquet\b"),
]


def summarise(plan: str) -> dict[str, int]:
    plan = re.sub(r"\bReusedExchange.*", "", plan)  # its line repeats the exchange that it reuses
    return {name: len(re.findall(rx, plan)) for name, rx in OPS}


def main() -> None:
    args = [a for a in sys.argv[1:] if a != "--no-broadcast"]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1"} if "--no-broadcast" in sys.argv else {}
    spark = local_session(cores=4, shuffle_partitions=8, extra=off)
    inputs = tempfile.mkdtemp(prefix="subrecon-plans-")
    stage_inputs(spark, sf_dir, inputs, files=4)
    ev = Evidence.read(spark, inputs)
    print("| query | " + " | ".join(n for n, _ in OPS) + " | join types |")
    print("| --- | " + " | ".join("---" for _ in OPS) + " | --- |")
    for name, build in BUILDERS.items():
        df = build(Reconciliation(ev))
        qe = df._jdf.queryExecution()
        qe.toRdd().count()  # runs this plan itself, so AQE finalises it
        plan = qe.executedPlan().toString().split("== Initial Plan ==")[0]
        s = summarise(plan)
        kinds = sorted(set(re.findall(r"(?:SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[[^\]]*\], "
                                      r"\[[^\]]*\], (\w+)", plan)))
        print(f"| {name} | " + " | ".join(str(s[n]) for n, _ in OPS) + f" | {', '.join(kinds)} |")


if __name__ == "__main__":
    main()
