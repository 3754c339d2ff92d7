"""User-level reports: small DataFrames of counts and percentages.

Each report is one Spark job over the per-key count tables of
``subrecon.plans.stats`` (or over the raw clickstream), with every
denominator computed in the same plan; nothing is counted eagerly on the
driver. Ratios use ``percent``: unrounded DOUBLE, null on a zero
denominator.

Long-format reports have the columns
``metric STRING, numerator BIGINT, denominator BIGINT, percent DOUBLE``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subrecon.functions.expressions import COUNT, count_where, exact, percent, published
from subrecon.functions.values import CLICK_RECORD, NO, RESPONSE_RECORD, YES
from subrecon.plans.stats import sum_exact, totals


def _long(one_row: DataFrame, rows: Sequence[tuple[str, str, str | None]]) -> DataFrame:
    """Turn a one-row aggregate into ``(metric, numerator, denominator, percent)``
    rows; ``rows`` = (metric, numerator column, denominator column or None)."""
    structs = []
    for metric, num, den in rows:
        d = published(den, den) if den else F.lit(None)
        structs.append(F.struct(
            F.lit(metric).alias("metric"),
            published(num, metric).alias("numerator"),
            d.cast("bigint").alias("denominator"),
            (percent(num, den) if den else F.lit(None).cast("double")).alias("percent"),
        ))
    return one_row.select(F.inline(F.array(*structs)))


def _flag_rows(one_row: DataFrame, flag: str, yes: str, no: str, total: str) -> DataFrame:
    """Rows ``(flag, count, total, percent)`` for the flag values present."""
    structs = [
        F.struct(F.lit(v).alias(flag), published(n, n).alias("count"),
                 published(total, total).alias("total"), percent(n, total).alias("percent"))
        for v, n in ((YES, yes), (NO, no))
    ]
    return one_row.select(F.inline(F.array(*structs))).where(F.col("count") > 0)


def click_coverage(clicks: DataFrame) -> DataFrame:
    """Share of clickstream rows that carry an accept/reject answer.

    One row per ``click_record`` value present: count, total rows, percent.
    """
    agg = clicks.agg(
        count_where(F.col("sub_status").isNotNull()).alias("yes"),
        count_where(F.col("sub_status").isNull()).alias("no"),
        F.count("*").alias("total"),
    )
    return _flag_rows(agg, CLICK_RECORD, "yes", "no", "total")


def click_coverage_from_counts(stats: DataFrame) -> DataFrame:
    """The same from per-key counts that hold the raw-click coverage group."""
    agg = totals(stats, ["clicks", "clicks_with_answer"])
    agg = agg.withColumn("clicks_without", F.col("clicks") - F.col("clicks_with_answer"))
    return _flag_rows(agg, CLICK_RECORD, "clicks_with_answer", "clicks_without", "clicks")


def response_coverage(stats: DataFrame) -> DataFrame:
    """Flagged substitutions with / without a response answer.

    Counts are rows of the substitutions-left-join-responses relation; the
    percentage divides by the number of substitution events (not by the
    joined rows), so a duplicated response key can push the sum over 100.
    """
    agg = totals(stats, ["with_response", "without_response", "substitutions"])
    return _flag_rows(agg, RESPONSE_RECORD, "with_response", "without_response", "substitutions")


def reconciliation_summary(stats: DataFrame) -> DataFrame:
    """How substitutions and responses line up.

    substitutions, responses in scope and their inner-join size (no
    denominators); responses without any substitution and responses that
    are partner-fulfilled, each as a share of responses in scope;
    substitutions without a response answer as a share of substitutions.
    """
    agg = totals(stats, ["substitutions", "responses_in_scope", "matched_responses",
                         "responses_without_substitution", "partner_explained_responses",
                         "without_response"])
    return _long(agg, [
        ("substitutions", "substitutions", None),
        ("responses_in_scope", "responses_in_scope", None),
        ("matched_responses", "matched_responses", None),
        ("responses_without_substitution", "responses_without_substitution", "responses_in_scope"),
        ("partner_explained_responses", "partner_explained_responses", "responses_in_scope"),
        ("substitutions_without_response", "without_response", "substitutions"),
    ])


def recovery_rate(stats: DataFrame) -> DataFrame:
    """Of the reconciled rows without a response answer, the share that has
    an answer in the clickstream."""
    agg = totals(stats, ["recovered_from_clicks", "unanswered"])
    return _long(agg, [("recovered_from_clicks", "recovered_from_clicks", "unanswered")])


def contradiction_matrix(stats: DataFrame) -> DataFrame:
    """Response answer vs click answer, over rows answered in both.

    ``contradictions`` / ``accept_vs_accepted`` / ``reject_vs_rejected`` /
    ``other`` are shares of answered-in-both rows (``other``: any status
    outside the four compared values); ``accept_vs_rejected`` and
    ``reject_vs_accepted`` are shares of the contradictions.
    """
    agg = totals(stats, ["answered_in_both", "contradictions", "accept_vs_rejected",
                         "reject_vs_accepted", "accept_vs_accepted", "reject_vs_rejected"])
    agg = agg.withColumn("other", F.col("answered_in_both") - F.col("contradictions")
                         - F.col("accept_vs_accepted") - F.col("reject_vs_rejected"))
    return _long(agg, [
        ("contradictions", "contradictions", "answered_in_both"),
        ("accept_vs_rejected", "accept_vs_rejected", "contradictions"),
        ("reject_vs_accepted", "reject_vs_accepted", "contradictions"),
        ("accept_vs_accepted", "accept_vs_accepted", "answered_in_both"),
        ("reject_vs_rejected", "reject_vs_rejected", "answered_in_both"),
        ("other", "other", "answered_in_both"),
    ])


def _register_totals(reg: DataFrame, rows_col: str) -> DataFrame:
    rows = F.col(rows_col)
    return reg.agg(
        F.coalesce(F.sum(rows), F.lit(0)).cast(COUNT).alias("total"),
        F.coalesce(F.sum(rows * exact("lines")), F.lit(0)).cast(COUNT).alias("inner_rows"),
        F.coalesce(F.sum(F.when(F.col("lines") > 0, rows).otherwise(F.lit(0))), F.lit(0))
        .cast(COUNT).alias("semi_rows"),
    )


def contradiction_register_check(reg: DataFrame) -> DataFrame:
    """Contradictions, and how many are found on the register.

    ``on_register_inner`` is the inner-join row count the analysis compares
    with the contradictions (it counts a row once per register line);
    ``on_register_semi`` counts each contradiction row at most once.
    Equal counts prove full coverage only when the two agree.
    """
    agg = _register_totals(reg, "contra_rows")
    return _long(agg, [
        ("contradictions", "total", None),
        ("on_register_inner", "inner_rows", "total"),
        ("on_register_semi", "semi_rows", "total"),
    ])


def unanswered_register_rate(reg: DataFrame) -> DataFrame:
    """Unanswered reconciled rows whose picked item is on the register.

    A purchase is an *inferred* acceptance at best (the item may have been
    bought separately). Inner-join count (can exceed 100 %) and row-true
    semi-join count, both over the unanswered rows.
    """
    agg = _register_totals(reg, "unans_rows")
    return _long(agg, [
        ("unanswered", "total", None),
        ("inferred_purchase_inner", "inner_rows", "total"),
        ("inferred_purchase_semi", "semi_rows", "total"),
    ])


def upc_mapping_coverage(upc: DataFrame) -> DataFrame:
    """Rows whose UPC is found in the product dimension, per UPC use.

    ordered / picked UPC of flagged substitutions and ordered UPC of click
    rows against the GTIN (inner-join row counts, as the lookups produce);
    click ordered UPC against the base UPC (semi join: base UPCs repeat);
    click substitute UPC (exploded pairs) against the GTIN.
    """
    gsum = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast(COUNT)
    agg = upc.agg(
        _row_sum("w_o", "g").alias("ordered_hit"), _row_sum("w_o").alias("ordered_all"),
        _row_sum("w_p", "g").alias("picked_hit"), _row_sum("w_p").alias("picked_all"),
        _row_sum("w_c", "g").alias("click_hit"), _row_sum("w_c").alias("click_all"),
        gsum(F.when(F.col("b") > 0, F.col("w_c")).otherwise(F.lit(0))).alias("click_base_hit"),
        _row_sum("w_s", "g").alias("click_sub_hit"), _row_sum("w_s").alias("click_sub_all"),
    )
    return _long(agg, [
        ("ordered_upc_gtin", "ordered_hit", "ordered_all"),
        ("picked_upc_gtin", "picked_hit", "picked_all"),
        ("click_upc_gtin", "click_hit", "click_all"),
        ("click_upc_base", "click_base_hit", "click_all"),
        ("click_sub_upc_gtin", "click_sub_hit", "click_sub_all"),
    ])


PERIOD_METRICS = ("substitutions", "responses_in_scope", "matched_responses", "without_response",
                  "responses_without_substitution", "partner_explained_responses", "unanswered",
                  "recovered_from_clicks", "answered_in_both", "contradictions",
                  "accept_vs_rejected", "reject_vs_accepted")


#: Register and product figures of a period: name -> its rows per register key or UPC.
PERIOD_REGISTER = {
    "contradictions_on_register": ("contra_rows", True), "contradictions_found_on_register": ("contra_rows", False),
    "unanswered_on_register": ("unans_rows", True), "unanswered_found_on_register": ("unans_rows", False),
}
PERIOD_UPC = {"ordered_upc_mapped": ("w_o", "g"), "picked_upc_mapped": ("w_p", "g"), "click_upc_mapped": ("w_c", "g"),
              "click_upc_base_mapped": ("w_c", "b"), "click_sub_upc_mapped": ("w_s", "g")}
PERIOD_UPC_ALL = {"response_flagged_rows": "w_o", "click_pairs": "w_s"}


def _row_sum(weight: str, times: str | None = None) -> Column:
    """Exact sum of a weight, or of its products with a count: BIGINT where both are small."""
    w, few = F.col(weight), F.col(weight) <= 1_000_000
    if times is None:
        return sum_exact(few, w.cast("bigint"), w)
    return sum_exact(few & (F.col(times) <= 1_000), w.cast("bigint") * F.col(times).cast("bigint"), w * exact(times))


def period_figures(counts: DataFrame, register: DataFrame, upc: DataFrame, period_col: str, name: Column) -> DataFrame:
    """``period_table`` from ``period_counts``, ``period_register`` and ``period_upcs``; ``name`` is that of a period's number.

    Each is summed per period, and the three are put side by side by one more sum. Clicks are counted by
    their UPC, so they are read once.
    """
    none = F.lit(0).cast("bigint")

    def total(weight: str, of: DataFrame, times: str | None = None, hit: str | None = None) -> Column:
        """Exact sum of a weight, or of its products with a count, or over the rows with a ``hit``."""
        w, large = F.coalesce(F.col(weight), none), f"{weight}_large" in of.columns
        t = F.coalesce(F.col(times), none) if times else F.lit(1).cast("bigint")
        few = (w <= 1_000_000) & (t <= 1_000)
        slow = exact(w) + F.coalesce(F.col(f"{weight}_large"), none) if large else exact(w)
        if large:
            few &= F.col(f"{weight}_large").isNull()
        at = F.col(hit) > 0 if hit else F.lit(True)
        return sum_exact(few, F.when(at, w * t), F.when(at, slow * exact(t)))

    sums = [
        totals(counts, PERIOD_METRICS, by=[period_col]).withColumn("__present", F.lit(1)),
        register.groupBy(period_col).agg(*[total(w, register, "lines" if lines else None).alias(n)
                                           for n, (w, lines) in PERIOD_REGISTER.items()]),
        upc.groupBy(period_col).agg(
            *[total(w, upc, *((d, None) if d == "g" else (None, d))).alias(n) for n, (w, d) in PERIOD_UPC.items()],
            *[total(w, upc).alias(n) for n, w in PERIOD_UPC_ALL.items()],
            total("w_c", upc).alias("clicks"), total("w_a", upc).alias("clicks_with_answer")),
    ]
    names = (*PERIOD_METRICS, "clicks", "clicks_with_answer", *PERIOD_REGISTER, *PERIOD_UPC, *PERIOD_UPC_ALL)
    u = reduce(DataFrame.unionByName, [d.select(period_col, *[
        (F.col(n) if n in d.columns else F.lit(None)).cast(COUNT).alias(n) for n in (*names, "__present")]) for d in sums])
    t = u.groupBy(period_col).agg(*[F.coalesce(F.sum(n), F.lit(0)).cast(COUNT).alias(n) for n in (*names, "__present")])
    t = t.where((F.col("__present") > 0) | (F.col("clicks") > 0)).withColumn(period_col, name)
    return _period_columns(t, period_col, names)


def period_table(stats: DataFrame, period_col: str, register: DataFrame, upc: DataFrame) -> DataFrame:
    """All figures, one row per period (wide format), from per-key counts
    (with the raw-click coverage groups), register counts and UPC counts keyed
    by period. The three are summed per period and put side by side by one more
    sum over their union: no join. Periods without substitutions, responses, partner events
    and clicks have no row.
    """
    names = PERIOD_METRICS + ("clicks", "clicks_with_answer")
    from_stats = totals(stats, names, by=[period_col]).withColumn("__present", F.lit(1).cast(COUNT))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast(COUNT)
    from_register = register.groupBy(period_col).agg(*[
        total(F.col(w) * exact("lines") if lines else F.when(F.col("lines") > 0, F.col(w))).alias(n)
        for n, (w, lines) in PERIOD_REGISTER.items()])
    from_upc = upc.groupBy(period_col).agg(
        *[total(F.col(w) * F.col(d) if d == "g" else F.when(F.col(d) > 0, F.col(w))).alias(n)
          for n, (w, d) in PERIOD_UPC.items()],
        *[total(F.col(w)).alias(n) for n, w in PERIOD_UPC_ALL.items()])
    names += tuple(PERIOD_REGISTER) + tuple(PERIOD_UPC) + tuple(PERIOD_UPC_ALL)
    parts = [d.select(period_col, *[F.col(n) if n in d.columns else F.lit(0).cast(COUNT).alias(n)
                                    for n in (*names, "__present")]) for d in (from_stats, from_register, from_upc)]
    t = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(period_col).agg(
        *[total(F.col(n)).alias(n) for n in (*names, "__present")]).where(F.col("__present") > 0)
    return _period_columns(t, period_col, names)


def _period_columns(t: DataFrame, period_col: str, names: Sequence[str]) -> DataFrame:
    """Published counts and their shares."""
    return t.select(
        period_col, *[published(n, n).alias(n) for n in names],
        percent("without_response", "substitutions").alias("pct_without_response"),
        percent("responses_without_substitution", "responses_in_scope")
        .alias("pct_responses_without_substitution"),
        percent("partner_explained_responses", "responses_in_scope").alias("pct_partner_explained"),
        percent("recovered_from_clicks", "unanswered").alias("pct_recovered"),
        percent("contradictions", "answered_in_both").alias("pct_contradictions"),
        percent("accept_vs_rejected", "contradictions").alias("pct_accept_vs_rejected"),
        percent("reject_vs_accepted", "contradictions").alias("pct_reject_vs_accepted"),
        percent("clicks_with_answer", "clicks").alias("pct_clicks_with_answer"),
        percent("contradictions_found_on_register", "contradictions").alias("pct_contradictions_found_on_register"),
        percent("unanswered_found_on_register", "unanswered").alias("pct_unanswered_found_on_register"),
        percent("ordered_upc_mapped", "response_flagged_rows").alias("pct_ordered_upc_mapped"),
        percent("picked_upc_mapped", "response_flagged_rows").alias("pct_picked_upc_mapped"),
        percent("click_upc_mapped", "clicks").alias("pct_click_upc_mapped"),
        percent("click_upc_base_mapped", "clicks").alias("pct_click_upc_base_mapped"),
        percent("click_sub_upc_mapped", "click_pairs").alias("pct_click_sub_upc_mapped"),
    )
