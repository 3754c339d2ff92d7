"""The reconciliation analysis wired together for one set of inputs.

``Reconciliation`` builds every relation and report lazily from an
``Evidence`` bundle; attributes are memoised *plans*, not cached data, so
nothing runs until a report is written or collected. The job may swap the
per-key count table for a materialised copy (``with_stats``) so several
reports share one computation; once materialised, the key audit and the
per-order reports are derived from the count and register tables instead of
rescanning the inputs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subrecon import operators as ops
from subrecon.plans import reports as R
from subrecon.plans.period_stats import dated_evidence, period_counts, period_register, period_upcs
from subrecon.plans.stats import (
    flagged_weights,
    key_stats,
    register_weights,
    register_weights_one_pass,
    upc_counts,
)
from subrecon.sources.contracts import ContractError
from subrecon.sources.period import Period, month_name, month_number, numbers_of, name_of
from subrecon.sources.tables import Evidence
from subrecon.functions.values import CLICK_KEYS, REGISTER_KEYS, SUB_KEYS


@dataclass
class Reconciliation:
    ev: Evidence
    _stats: DataFrame | None = field(default=None, repr=False)
    # True once the count tables are materialised: reports then reuse them
    # instead of rescanning the inputs.
    materialized: bool = False

    # -- relations ---------------------------------------------------------
    @cached_property
    def click_subs(self) -> DataFrame:
        return ops.click_subs(self.ev.clicks)

    @cached_property
    def click_pairs(self) -> DataFrame:
        return ops.click_pairs(self.click_subs)

    @cached_property
    def responses(self) -> DataFrame:
        return ops.responses_in_scope(self.ev.response_events)

    @cached_property
    def response_flagged(self) -> DataFrame:
        return ops.response_flagged(self.ev.substitution_events, self.responses)

    @cached_property
    def evidence_keys(self) -> DataFrame:
        return ops.evidence_keys(self.ev.substitution_events, self.responses, ops.exploded_clicks(self.click_subs))

    @cached_property
    def reconciled(self) -> DataFrame:
        keys = self.evidence_keys
        flagged = ops.response_flagged(self.ev.substitution_events, self.responses, keys)
        return ops.reconciled(flagged, self.click_pairs, sides=keys)

    @property
    def flagged_weights(self) -> DataFrame:
        return flagged_weights(self.stats_for("R"))

    @cached_property
    def unanswered(self) -> DataFrame:
        return ops.unanswered(self.reconciled)

    @cached_property
    def contradictions(self) -> DataFrame:
        return ops.contradictions(self.reconciled)

    # -- shared count tables -------------------------------------------------
    @property
    def stats(self) -> DataFrame:
        """Per-key counts of all four sources, plus the raw-click coverage
        group (what the job materialises)."""
        if self._stats is None:
            self._stats = key_stats(self.ev.substitution_events, self.responses,
                                    self.ev.partner_events, self.click_pairs,
                                    raw_clicks=self.ev.clicks)
        return self._stats

    def stats_for(self, *sources: str) -> DataFrame:
        """Per-key counts using only ``sources`` among 'R', 'P', 'C' (plus the
        substitutions), unless the full table is already set."""
        if self._stats is not None:
            return self._stats
        return key_stats(
            self.ev.substitution_events,
            self.responses if "R" in sources else None,
            self.ev.partner_events if "P" in sources else None,
            self.click_pairs if "C" in sources else None,
        )

    def with_stats(self, stats: DataFrame, materialized: bool = True) -> "Reconciliation":
        self._stats = stats
        self.materialized = materialized
        for k in ("register", "upc"):
            self.__dict__.pop(k, None)
        return self

    @cached_property
    def register(self) -> DataFrame:
        if self._stats is not None:
            weights = register_weights(self.ev.substitution_events, self._stats)
        else:
            weights = register_weights_one_pass(self.ev.substitution_events, self.responses,
                                                self.click_pairs)
        return ops.register_counts(weights, self.ev.transactions)

    @cached_property
    def upc(self) -> DataFrame:
        return upc_counts(self.stats_for("R", "C"), self.ev.clicks, self.ev.products)

    # -- reports -------------------------------------------------------------
    def click_coverage(self) -> DataFrame:
        if self.materialized:
            return R.click_coverage_from_counts(self.stats)
        return R.click_coverage(self.ev.clicks)

    def response_coverage(self) -> DataFrame:
        return R.response_coverage(self.stats_for("R"))

    def reconciliation_summary(self) -> DataFrame:
        return R.reconciliation_summary(self.stats_for("R", "P"))

    def recovery_rate(self) -> DataFrame:
        return R.recovery_rate(self.stats_for("R", "C"))

    def contradiction_matrix(self) -> DataFrame:
        return R.contradiction_matrix(self.stats_for("R", "C"))

    def contradiction_register_check(self) -> DataFrame:
        return R.contradiction_register_check(self.register)

    def unanswered_register_rate(self) -> DataFrame:
        return R.unanswered_register_rate(self.register)

    def upc_mapping_coverage(self) -> DataFrame:
        return R.upc_mapping_coverage(self.upc)

    def _per_order(self) -> DataFrame:
        if self.materialized:
            return ops.orders_from_register(self.register)
        return ops.order_register_counts(self.ev.substitution_events, self.ev.transactions)

    def engaged_orders(self) -> DataFrame:
        return ops.engaged_orders(self._per_order())

    def order_register_profile(self) -> DataFrame:
        return ops.order_register_profile(self._per_order())

    def key_fanout_audit(self) -> DataFrame:
        ev = self.ev
        if self.materialized:
            keys, click_keys = ",".join(SUB_KEYS), ",".join(CLICK_KEYS)
            from_counts = ops.fanout_from_counts(self.stats, [
                ("substitution_events", keys, "s"), ("responses_in_scope", keys, "r"),
                ("partner_events", keys, "p"), ("click_pairs", click_keys, "c")])
            rest = ops.key_fanout_audit([
                ("transactions", ev.transactions, REGISTER_KEYS),
                ("products", ev.products, ("con_upc_no",)),
                ("products_base", ev.products, ("bas_con_upc_no",)),
            ])
            return from_counts.unionByName(rest)
        return ops.key_fanout_audit([
            ("substitution_events", ev.substitution_events, SUB_KEYS),
            ("responses_in_scope", self.responses, SUB_KEYS),
            ("partner_events", ev.partner_events, SUB_KEYS),
            ("click_pairs", self.click_pairs, CLICK_KEYS),
            ("transactions", ev.transactions, REGISTER_KEYS),
            ("products", ev.products, ("con_upc_no",)),
            ("products_base", ev.products, ("bas_con_upc_no",)),
        ])

    def period_comparison(self, period_col: str = "period") -> DataFrame:
        month = self.ev.period.month
        if month and (self.materialized or "event_date" not in self.ev.clicks.columns):
            # every input is already cut to this month (undated clicks are an
            # extract of it): its one row is the counts, labelled with the month
            label = lambda df: df.withColumn(period_col, F.lit(month))
            return R.period_table(label(self.stats), period_col, label(self.register), label(self.upc))
        return period_comparison(self.ev, period_col, pairs=self.pairs_by_period)

    #: Click pairs that carry their month, where the job has staged them.
    pairs_by_period: DataFrame | None = None

    def compare_periods(self, periods: Sequence[Period], period_col: str = "period") -> DataFrame:
        """The same figures for given periods instead of calendar months."""
        return period_comparison(self.ev, period_col, periods)


def period_comparison(ev: Evidence, period_col: str = "period", periods: Sequence[Period] | None = None,
                      pairs: DataFrame | None = None) -> DataFrame:
    """Headline figures per calendar month, or per given period, side by side.

    Every dated input gets ``period`` = month of its own date (or the label of
    each given period that holds the date), which joins the substitution key.
    That gives exactly the figures of one run per period (each source cut to
    it, then joined) in a single pass (``period_stats``), in which a number stands for the period. Rows with no date
    belong to no period. Clicks need an ``event_date``. ``pairs`` are monthly click pairs already made.
    """
    def per(df: DataFrame, c: str) -> DataFrame:
        if c not in df.columns:
            raise ContractError(f"period_comparison needs a {c!r} column on every dated input")
        number = month_number(c) if periods is None else numbers_of(c, periods)
        return df.withColumn(period_col, number).where(F.col(period_col).isNotNull())

    subs = per(ev.substitution_events, "event_date")
    resp = per(ops.responses_in_scope(ev.response_events), "response_date")
    partner = per(ev.partner_events, "event_date")
    clicks = per(ev.clicks, "event_date")
    if pairs is not None:
        pairs = pairs.withColumn(period_col, month_number(F.to_date(F.concat(period_col, F.lit("-01")))))
    evidence = dated_evidence(subs, resp, partner, clicks, period_col, pairs)
    register = period_register(evidence, per(ev.transactions, "transaction_date"), period_col)
    name = month_name(period_col) if periods is None else name_of(period_col, periods)
    return R.period_figures(period_counts(evidence, period_col), register, period_upcs(evidence, ev.products, period_col),
                            period_col, name)
