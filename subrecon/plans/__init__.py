"""Count tables, reports, the analysis wiring and the batch job."""

from subrecon.plans.analysis import Reconciliation, period_comparison

__all__ = ["Reconciliation", "period_comparison"]
