"""Per-key evidence counts: the shared input of most reports.

The reports count rows of outer joins (substitutions x responses x click
pairs, ...). Materialising those joins just to count them moves every row
through two sort-merge joins and, for a hot key, multiplies rows inside one
task. Instead each source is reduced to one row per substitution key in a
*single* aggregation over the union of all sources:

    union(substitutions, responses, partner events, click pairs)
      -> groupBy(key) sum(indicators)          # one shuffle, map-side combine

and the size of any join is then an exact sum of per-key products
(e.g. ``|S inner R| = sum(s * r)``, ``|S left R| = sum(s * max(r, 1))``).
A key holding a third of all rows becomes one row per map task before the
shuffle, so skew never reaches a reducer. Products and their sums are
DECIMAL(38,0), since those of one hot key can exceed BIGINT; published counts
are cast once, at the end.

Null keys never match in a join; to keep that, a row with any null key
column is grouped with its own source only (``null_side`` = the source
tag), so it counts as unmatched exactly as the join would treat it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subrecon.functions.expressions import COUNT, at_least_one, exact, none_to_one
from subrecon.functions.values import (
    CLICK_ACCEPTED,
    CLICK_REJECTED,
    RESPONSE_ACCEPT,
    RESPONSE_REJECT,
    SUB_KEYS,
)

COUNTS = ("s", "r", "r_null", "r_accept", "r_reject", "p",
          "c", "c_null", "c_accepted", "c_rejected", "k", "k_answered")


def _ind(cond: Column) -> Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def _side(df: DataFrame, tag: str, keys: Sequence[str], key_exprs: Sequence[Column],
          extra: Sequence[Column] = (), **counts: Column) -> DataFrame:
    any_null = None
    for k in key_exprs:
        any_null = k.isNull() if any_null is None else (any_null | k.isNull())
    cols = [k.alias(n) for n, k in zip(keys, key_exprs)]
    cols.append(F.when(any_null, F.lit(tag)).alias("null_side"))
    for c in COUNTS:
        cols.append((counts[c] if c in counts else F.lit(0).cast("bigint")).alias(c))
    return df.select(cols + list(extra))


def key_stats(substitutions: DataFrame, responses: DataFrame | None = None,
              partner_events: DataFrame | None = None, pairs: DataFrame | None = None,
              by: Sequence[str] = (), raw_clicks: DataFrame | None = None) -> DataFrame:
    """One row per (substitution key + ``by``) with the count of each source.

    Inputs: scoped substitution events, responses in scope, partner events,
    and exploded click pairs (``order_id, upc, sub_upc`` play the key). A
    source passed as ``None`` is left out (its counts are 0), so a report
    that needs no clicks never de-duplicates them.
    ``by`` columns (e.g. a period) must exist on every input and are part of
    the key, which is the same as running the analysis once per ``by`` value.
    ``raw_clicks`` (clickstream rows before exploding) only adds click
    coverage per ``by`` value: they form one group per ``by`` value of their
    own (``null_side`` 'K', key parts null), which map-side aggregation
    collapses to one row per task.
    Columns: the keys, ``null_side``, and ``s r r_null r_accept r_reject p c
    c_null c_accepted c_rejected k k_answered``.
    """
    keys = list(SUB_KEYS) + list(by)
    sub_k = [F.col(k) for k in keys]
    click_k = [F.col("order_id"), F.col("upc"), F.col("sub_upc")] + [F.col(b) for b in by]
    one = F.lit(1).cast("bigint")
    st, ss = F.col("status"), F.col("sub_status")
    parts = [_side(substitutions, "S", keys, sub_k, s=one)]
    if responses is not None:
        parts.append(_side(responses, "R", keys, sub_k, r=one, r_null=_ind(st.isNull()),
                           r_accept=_ind(st == RESPONSE_ACCEPT), r_reject=_ind(st == RESPONSE_REJECT)))
    if partner_events is not None:
        parts.append(_side(partner_events, "P", keys, sub_k, p=one))
    if pairs is not None:
        parts.append(_side(pairs, "C", keys, click_k, c=one, c_null=_ind(ss.isNull()),
                           c_accepted=_ind(ss == CLICK_ACCEPTED), c_rejected=_ind(ss == CLICK_REJECTED)))
    if raw_clicks is not None:
        none = F.lit(None).cast("string")
        k = raw_clicks.select(*[none.alias(n) for n in SUB_KEYS], *[F.col(b) for b in by],
                              F.lit("K").alias("null_side"),
                              *[(one if c == "k" else _ind(ss.isNotNull()) if c == "k_answered"
                                 else F.lit(0).cast("bigint")).alias(c) for c in COUNTS])
        parts.append(k)
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy(*keys, "null_side").agg(*[F.sum(c).cast("bigint").alias(c) for c in COUNTS])


# --- per-key row counts of the reference joins, as column expressions -------
def terms(number: Callable[[str], Column] = exact) -> dict[str, Column]:
    """Row count, per ``key_stats`` row, of each relation the reports count; ``number`` makes a count a factor."""
    s, r, p, c = (number(x) for x in ("s", "r", "p", "c"))
    r_answered = r - number("r_null")             # response rows with a status
    c_answered = c - number("c_null")             # click rows with a sub_status
    r_missing = number("r_null") + none_to_one(r)  # left-join rows with null status
    t = {
        "substitutions": s,
        "responses_in_scope": r,
        "matched_responses": s * r,
        "response_flagged_rows": s * at_least_one(r),
        "with_response": s * r_answered,
        "without_response": s * r_missing,
        "responses_without_substitution": r * none_to_one(s),
        "responses_right_join_rows": r * at_least_one(s),
        "partner_explained_responses": r * p,
        "reconciled_rows": s * at_least_one(r) * at_least_one(c),
        "unanswered": s * r_missing * at_least_one(c),
        "recovered_from_clicks": s * r_missing * c_answered,
        "answered_in_both": s * r_answered * c_answered,
        "accept_vs_rejected": s * number("r_accept") * number("c_rejected"),
        "reject_vs_accepted": s * number("r_reject") * number("c_accepted"),
        "accept_vs_accepted": s * number("r_accept") * number("c_accepted"),
        "reject_vs_rejected": s * number("r_reject") * number("c_rejected"),
        "clicks": F.col("k"),
        "clicks_with_answer": F.col("k_answered"),
    }
    t["contradictions"] = t["accept_vs_rejected"] + t["reject_vs_accepted"]
    return t


def contradiction_rows_per_sub(number: Callable[[str], Column] = exact) -> Column:
    """Reconciled contradiction rows one substitution *row* yields; ``number`` makes a count a factor."""
    return number("r_accept") * number("c_rejected") + number("r_reject") * number("c_accepted")


def unanswered_rows_per_sub(number: Callable[[str], Column] = exact) -> Column:
    """Reconciled unanswered rows one substitution *row* yields."""
    return (number("r_null") + none_to_one(F.col("r"))) * at_least_one(number("c"))


#: Products of three counts up to this stay below 2^24, so BIGINT holds the sum of 5 * 10^11 of them.
SMALL_COUNT = 255


def sum_exact(small: Column, fast: Column, slow: Column) -> Column:
    """Exact sum: ``fast`` (BIGINT) over the rows whose factors are ``small``, ``slow`` (exact) over the others."""
    small = F.coalesce(small, F.lit(False))
    part = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast(COUNT)
    return (part(F.when(small, fast)) + part(F.when(~small, slow))).cast(COUNT)


def totals(stats: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sum the named ``terms()`` over ``stats`` (grouped by ``by``, if any), exactly.

    Almost all keys have few rows: their products are BIGINTs, and only those of hot keys are DECIMALs.
    """
    small = F.greatest("s", "r", "p", "c") <= SMALL_COUNT
    fast, slow = terms(F.col), terms()
    aggs = [sum_exact(small, fast[n], slow[n]).alias(n) for n in names]
    return stats.groupBy(*by).agg(*aggs) if by else stats.agg(*aggs)


def flagged_weights(stats: DataFrame) -> DataFrame:
    """Substitution keys with the number ``n`` of flagged rows (``response_flagged``) of each, from counts with responses."""
    return stats.where(F.col("s") > 0).select(*SUB_KEYS, (exact("s") * at_least_one(exact("r"))).cast(COUNT).alias("n"))


def register_weights(substitutions: DataFrame, stats: DataFrame) -> DataFrame:
    """Substitutions per register key, weighted by the reconciled rows each
    yields that are contradictions or unanswered.

    Substitutions are first reduced per (key, store) so a hot key is one
    row per store before the join with ``stats``. Substitutions whose key
    has a null part match no response or click: 0 contradiction rows,
    1 unanswered row.
    """
    keys = list(SUB_KEYS)
    per_store = substitutions.groupBy(*keys, "store_code").agg(F.count("*").alias("subs"))
    factors = stats.where(F.col("null_side").isNull() & (F.col("s") > 0)).select(
        *keys,
        contradiction_rows_per_sub().alias("contra_f"),
        unanswered_rows_per_sub().alias("unans_f"),
    )
    j = per_store.join(factors, keys, "left")
    return j.select(
        "order_no",
        F.col("picked_upc").alias("gtin_no"),
        "store_code",
        (exact("subs") * F.coalesce(F.col("contra_f"), F.lit(0))).cast(COUNT).alias("contra_rows"),
        (exact("subs") * F.coalesce(F.col("unans_f"), F.lit(1))).cast(COUNT).alias("unans_rows"),
        F.col("subs").cast("bigint").alias("subs"),
    )


def register_weights_one_pass(substitutions: DataFrame, responses: DataFrame,
                              pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``register_weights`` without a count table to reuse.

    One aggregation over the union of the three sources, keyed by
    (key, null_side, is-substitution, store): substitutions keep their store,
    responses and click pairs have none. A window over the key then puts the
    key's response and click counts on each substitution-store row. The
    substitutions are scanned once, a hot key is pre-aggregated map-side,
    and its window partition holds one row per store plus two.
    Columns and meaning as ``register_weights``, then ``by`` (columns of every
    input that are part of the key, as for ``key_stats``).
    """
    keys = [*SUB_KEYS, *by]
    sub_k = [F.col(k) for k in keys]
    click_k = [F.col(k) for k in ("order_id", "upc", "sub_upc", *by)]
    one = F.lit(1).cast("bigint")
    st, ss = F.col("status"), F.col("sub_status")
    own_store = [F.lit(True).alias("is_sub"), F.col("store_code")]
    no_store = [F.lit(False).alias("is_sub"), F.lit(None).cast("string").alias("store_code")]
    parts = [
        _side(substitutions, "S", keys, sub_k, own_store, s=one),
        _side(responses, "R", keys, sub_k, no_store, r=one, r_null=_ind(st.isNull()),
              r_accept=_ind(st == RESPONSE_ACCEPT), r_reject=_ind(st == RESPONSE_REJECT)),
        _side(pairs, "C", keys, click_k, no_store, c=one,
              c_accepted=_ind(ss == CLICK_ACCEPTED), c_rejected=_ind(ss == CLICK_REJECTED)),
    ]
    u = parts[0]
    for q in parts[1:]:
        u = u.unionByName(q)
    counts = ("s", "r", "r_null", "r_accept", "r_reject", "c", "c_accepted", "c_rejected")
    agg = u.groupBy(*keys, "null_side", "is_sub", "store_code").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in counts])
    w = Window.partitionBy(*keys, "null_side")
    per_key = agg.select(
        *keys, "store_code", "is_sub", "s",
        *[F.sum(c).over(w).alias(c) for c in counts if c != "s"],
    ).where(F.col("is_sub"))
    return per_key.select(
        "order_no",
        F.col("picked_upc").alias("gtin_no"),
        "store_code",
        (exact("s") * contradiction_rows_per_sub()).cast(COUNT).alias("contra_rows"),
        (exact("s") * unanswered_rows_per_sub()).cast(COUNT).alias("unans_rows"),
        F.col("s").cast("bigint").alias("subs"), *by,
    )


def upc_counts(stats: DataFrame, clicks: DataFrame, products: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per UPC: rows of each feed carrying it, and product-dimension hits.

    ``w_o`` / ``w_p``: flagged-substitution rows by ordered / picked UPC;
    ``w_s``: click pairs by substitute UPC; all three come from the per-key
    counts (``stats`` with responses and clicks), since a click pair's
    substitute UPC is the picked-UPC part of its key. ``w_c``: clickstream
    rows by ordered UPC (one column of the raw clicks), ``w_a``: those with an answer; ``g`` / ``b``:
    products with that GTIN / base UPC. One aggregation over a union, no
    join with the dimension (whose size is not bounded by anything we
    control). ``by`` columns of ``stats`` and ``clicks`` split the weights;
    products belong to every ``by`` value, so a window over the UPC (one row a
    ``by`` value) puts their counts on each.
    """
    one = F.lit(1)
    names = ("w_o", "w_p", "w_c", "w_a", "w_s", "g", "b")
    large = {"w_o": "w_o_large", "w_p": "w_p_large"}  # products of two counts: exact where one is large; all other sums fit BIGINT
    columns = (*names, *large.values())

    def row(upc: Column, dated: bool = True, **w: Column) -> Column:
        label = [F.col(b) if dated else F.lit(None).cast("string").alias(b) for b in by]
        # what a row does not add is null, not 0: sums pass nulls by
        return F.struct(upc.alias("upc"), *label, *[w.get(n, F.lit(None)).cast(
            COUNT if n in large.values() else "bigint").alias(n) for n in columns])

    def part(df: DataFrame, *rows: Column) -> DataFrame:
        """Each input row yields ``rows`` (one pass, one scan, however many uses)."""
        return df.select(F.explode(F.array(*rows)).alias("x")).select("x.*") if len(rows) > 1 else df.select(
            rows[0].alias("x")).select("x.*")

    small = F.greatest("s", "r") <= SMALL_COUNT
    few = F.when(small, F.col("s") * at_least_one(F.col("r")))
    many = F.when(~small, exact("s") * at_least_one(exact("r")))
    parts = [
        part(stats, row(F.col("ordered_upc"), w_o=few, w_o_large=many),
             row(F.col("picked_upc"), w_p=few, w_p_large=many, w_s=F.col("c"))),
        part(clicks, row(F.col("upc"), w_c=one, w_a=_ind(F.col("sub_status").isNotNull()))),
        # a product key that is null can never match, so it is dropped
        part(products, row(F.col("con_upc_no"), False, g=one), row(F.col("bas_con_upc_no"), False, b=one))
        .where(F.col("upc").isNotNull()),
    ]
    u = parts[0]
    for q in parts[1:]:
        u = u.unionByName(q)
    counts = u.groupBy("upc", *by).agg(*[F.sum(n).alias(n) for n in columns])
    if by:
        same = Window.partitionBy("upc")
        counts = counts.withColumns({n: F.sum(n).over(same) for n in ("g", "b")}).where(F.col(by[0]).isNotNull())
    number = lambda n: F.coalesce(F.col(n), F.lit(0)).cast(COUNT)
    return counts.select("upc", *by, *[
        ((number(n) + number(large[n])).cast(COUNT) if n in large else number(n)).alias(n) for n in names])
