"""Evidence counts per period: what ``period_comparison`` sums.

Every dated row moves once, dealt by its order and ordered UPC, as a narrow row: its keys, its period as a number, the
store of a substitution, what kind of row it is, and, for a click, its list of substitutes and a fingerprint of the
columns by which equal click pairs are told (``click_rows``). Totals, register weights and UPC weights all read that one
exchange; repeated click pairs are dropped and keys are counted where the rows have met, so none of it is
shuffled again. Only what leaves a key is: the weights that the register can confirm (by register key), and the
weights of each UPC (by UPC, beside the products).

Rows of a key that repeats without end meet in one task, which counts them into one row. A popular UPC does not: its
weights are first summed per bucket (``BUCKETS``) of orders and ordered UPCs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subrecon import operators as ops
from subrecon.functions.expressions import COUNT, at_least_one, exact
from subrecon.functions.values import (
    CLICK_ACCEPTED,
    CLICK_RECORD,
    CLICK_REJECTED,
    REGISTER_KEYS,
    RESPONSE_ACCEPT,
    RESPONSE_REJECT,
    SUB_KEYS,
)
from subrecon.plans.stats import SMALL_COUNT, contradiction_rows_per_sub, unanswered_rows_per_sub

KEYS = list(SUB_KEYS)
BUCKET, KIND, SUBS, PRINT, REAL = "__bucket", "__kind", "__subs", ("__print_1", "__print_2"), "__real"
MARK = "__mark"  # a row's period and kind in one number, as it is shuffled
#: Buckets that rows are dealt by: most tasks that can share the work, and most rows of one UPC and period that meet.
BUCKETS = 1 << 16
# kinds of rows; a response's and a click's also tell its answer
SUB, R_NULL, R_ACCEPT, R_REJECT, R_OTHER, PARTNER, C_NULL, C_ACCEPTED, C_REJECTED, C_OTHER = range(KINDS := 10)
#: Types whose values ``xxhash64`` tells apart as grouping does.
HASHED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def _answer(status: str, null: int, values: dict[str, int], other: int) -> Column:
    kind = F.when(F.col(status).isNull(), F.lit(null))
    for value, code in values.items():
        kind = kind.when(F.col(status) == value, F.lit(code))
    return kind.otherwise(F.lit(other))


def _rows(df: DataFrame, by: str, kind: Column, keys: Sequence[str] = KEYS, **more: Column) -> DataFrame:
    order_no, ordered, picked = [F.col(k) if k else F.lit(None).cast("string") for k in keys]
    null = {"store_code": "string", SUBS: "array<string>", PRINT[0]: "bigint", PRINT[1]: "bigint"}
    return df.select(
        order_no.alias("order_no"), ordered.alias("ordered_upc"), picked.alias("picked_upc"),
        (F.col(by) * KINDS + kind).cast("int").alias(MARK),
        *[more.get(c, F.lit(None)).cast(kind_).alias(c) for c, kind_ in null.items()],
        *[v.alias(c) for c, v in more.items() if c not in null])


def click_rows(clicks: DataFrame, by: str) -> tuple[DataFrame, list[str]]:
    """Clicks with their substitutes and a fingerprint of what else tells pairs apart, and the columns kept beside it.

    Pairs of one order, UPC, substitute and period are equal where all other columns that ``click_subs`` keeps are. Two
    64-bit hashes, seeded unlike each other, of those and of which of them are null stand for them; columns of nested or collated
    types, in which hashing and grouping may differ, are kept as they are. Clicks without substitutes need none.
    """
    subs = ops.click_subs(clicks, extras=[by])
    others = [f for f in subs.schema.fields if f.name not in ("sub_upc", "upc", "order_id", CLICK_RECORD, by)]
    plain = [f.name for f in others if isinstance(f.dataType, HASHED) or f.dataType == T.StringType()]
    kept = [f.name for f in others if f.name not in plain]
    nulls = F.concat(*[F.when(F.col(c).isNull(), F.lit("0")).otherwise(F.lit("1")) for c in plain])
    listed = F.size("sub_upc") > 0
    first, second = F.xxhash64(nulls, *plain), F.xxhash64(F.lit("pairs"), *reversed(plain), nulls)
    kind = _answer("sub_status", C_NULL, {CLICK_ACCEPTED: C_ACCEPTED, CLICK_REJECTED: C_REJECTED}, C_OTHER)
    return _rows(subs, by, kind, ("order_id", "upc", ""), **{
        SUBS: F.when(listed, F.col("sub_upc")), PRINT[0]: F.when(listed, first), PRINT[1]: F.when(listed, second),
        **{f"__kept_{i}": F.when(listed, F.col(c)) for i, c in enumerate(kept)}}), [f"__kept_{i}" for i in range(len(kept))]


def dated_evidence(substitutions: DataFrame, responses: DataFrame, partner_events: DataFrame, clicks: DataFrame,
                   by: str, pairs: DataFrame | None = None) -> DataFrame:
    """How often each row of evidence occurs, with click pairs counted once however often they repeat.

    One row per (key, ``by``, kind, store), and per fingerprint of a click pair: ``n`` rows of it and ``k`` clicks; ``__real``
    is false for clicks without substitutes, which are no evidence. ``pairs`` are click pairs already made. All
    columns of the exchange are grouped by, so Spark reuses it whatever is selected below.
    """
    response = _answer("status", R_NULL, {RESPONSE_ACCEPT: R_ACCEPT, RESPONSE_REJECT: R_REJECT}, R_OTHER)
    parts = [_rows(substitutions, by, F.lit(SUB), store_code=F.col("store_code")), _rows(responses, by, response),
             _rows(partner_events, by, F.lit(PARTNER))]
    if pairs is None:
        click, kept = click_rows(clicks, by)
        parts.append(click)
    else:
        kept, kind = [], _answer("sub_status", C_NULL, {CLICK_ACCEPTED: C_ACCEPTED, CLICK_REJECTED: C_REJECTED}, C_OTHER)
        parts += [_rows(clicks, by, kind, ("order_id", "upc", "")),
                  _rows(pairs, by, kind, ("order_id", "upc", ""), **{SUBS: F.array("sub_upc")})]
    met = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    bucket = F.pmod(F.hash("order_no", "ordered_upc"), F.lit(BUCKETS))
    kind = F.pmod(MARK, F.lit(KINDS))
    period = F.try_divide(F.col(MARK) - kind, F.lit(KINDS)).cast("int")
    met = met.repartition(bucket).select("*", bucket.alias(BUCKET), period.alias(by), kind.alias(KIND)).drop(MARK)
    picked = F.when(F.col(KIND) < C_NULL, F.array("picked_upc")).otherwise(F.col(SUBS))
    rows = met.select(*[c for c in met.columns if c not in ("picked_upc", SUBS)], F.posexplode_outer(picked).alias("__at", "picked_upc"))
    counted = F.col("__at").isNull() if pairs is not None else F.coalesce(F.col("__at") == 0, F.lit(True)) & (F.col(KIND) >= C_NULL)
    each = rows.groupBy(BUCKET, *KEYS, by, KIND, "store_code", *PRINT, *kept, F.col("__at").isNotNull().alias(REAL)).agg(
        F.count("*").alias("n"), F.sum(F.when(counted, 1).otherwise(0)).alias("k"))
    if pairs is None:
        each = each.withColumn("n", F.when(F.col(KIND) < C_NULL, F.col("n")).otherwise(F.lit(1).cast("bigint")))
    # a key with a null part meets its own source only
    any_null = reduce(Column.__or__, [F.col(c).isNull() for c in KEYS])
    source = F.when(~F.col(REAL), -1).when(F.col(KIND) < R_NULL, SUB).when(F.col(KIND) < PARTNER, R_NULL).when(
        F.col(KIND) < C_NULL, PARTNER).otherwise(C_NULL)
    return each.withColumn("null_side", F.when(any_null, source).cast("tinyint"))


def _counts(names: Sequence[str]) -> list[Column]:
    kind = F.when(F.col(REAL), F.col(KIND))
    of = {"s": kind == SUB, "r": kind.between(R_NULL, R_OTHER), "r_null": kind == R_NULL, "r_accept": kind == R_ACCEPT,
          "r_reject": kind == R_REJECT, "p": kind == PARTNER, "c": kind >= C_NULL, "c_null": kind == C_NULL,
          "c_accepted": kind == C_ACCEPTED, "c_rejected": kind == C_REJECTED}
    return [F.sum(F.when(of[c], F.col("n")).otherwise(0)).alias(c) for c in names]


def period_counts(evidence: DataFrame, by: str) -> DataFrame:
    """The counts of each key and ``by`` value that ``totals`` needs."""
    return evidence.where(REAL).groupBy(BUCKET, *KEYS, by, "null_side").agg(*_counts(
        ("s", "r", "r_null", "r_accept", "r_reject", "p", "c", "c_null", "c_accepted", "c_rejected")))


def period_register(evidence: DataFrame, transactions: DataFrame, by: str) -> DataFrame:
    """``register_counts`` per ``by`` value, of the register keys that have lines.

    Weights are BIGINTs (``contra_rows``, ``unans_rows``), exact ones of keys with large counts are in columns of
    their own (``*_large``). Substitutions without either, and those with a null in their register key, which no line has,
    are left out before the shuffle.
    """
    keys = [*REGISTER_KEYS, by]
    counts = ("s", "r", "r_null", "r_accept", "r_reject", "c", "c_accepted", "c_rejected")
    per_store = evidence.where(REAL).groupBy(BUCKET, *KEYS, by, "null_side", (F.col(KIND) == SUB).alias("is_sub"), "store_code").agg(
        *_counts(counts))
    same = Window.partitionBy(BUCKET, *KEYS, by, "null_side")
    subs = per_store.select(*KEYS, by, "is_sub", "store_code", "s", *[F.sum(c).over(same).alias(c) for c in counts[1:]]).where("is_sub")
    # the register key is asked for with the counts: by itself that would sink below the shared exchange, which then differs
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in ("order_no", "picked_upc", "store_code")])
    small = F.greatest("s", "r", "c") <= SMALL_COUNT
    weights = {"contra_rows": contradiction_rows_per_sub, "unans_rows": unanswered_rows_per_sub}
    columns = {n: F.when(known & small, F.col("s") * rows(F.col)) for n, rows in weights.items()} | {
        f"{n}_large": F.when(known & ~small, (exact("s") * rows()).cast(COUNT)) for n, rows in weights.items()}
    subs = subs.select("order_no", F.col("picked_upc").alias("gtin_no"), "store_code", by, *[v.alias(c) for c, v in columns.items()],
                       F.lit(None).cast("bigint").alias("lines"))
    lines = transactions.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in REGISTER_KEYS])).select(
        *keys, *[F.lit(None).cast(COUNT if c.endswith("large") else "bigint").alias(c) for c in columns],
        F.lit(1).cast("bigint").alias("lines"))
    return (subs.where(reduce(Column.__or__, [F.coalesce(F.col(c) > 0, F.lit(False)) for c in columns]))
            .unionByName(lines).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in (*columns, "lines")])
            .where(F.col("lines") > 0))


def period_upcs(evidence: DataFrame, products: DataFrame, by: str) -> DataFrame:
    """``upc_counts`` per ``by`` value. Products belong to every one, so a window over the UPC puts their counts on each.

    ``w_o`` and ``w_p`` of keys with large counts are in ``w_o_large`` and ``w_p_large``, exact.
    """
    weights = ("w_o", "w_p", "w_s", "w_c", "w_a")
    large = ("w_o_large", "w_p_large")

    def row(upc: str, **w: Column) -> Column:
        # what a row does not add is null, not 0: sums pass nulls by
        return F.struct(F.col(upc).alias("upc"), *[w.get(n, F.lit(None)).cast(COUNT if n in large else "bigint").alias(n)
                                                   for n in (*weights, *large)])

    stats = evidence.groupBy(BUCKET, *KEYS, by, "null_side").agg(
        *_counts(("s", "r", "c")), F.sum("k").alias("k"), F.sum(F.when(F.col(KIND) != C_NULL, F.col("k")).otherwise(0)).alias("k_answered"))
    small, some = F.greatest("s", "r") <= SMALL_COUNT, F.col("s") > 0
    few = F.when(some & small, F.col("s") * at_least_one(F.col("r")))
    many = F.when(some & ~small, exact("s") * at_least_one(exact("r")))
    ordered = F.when(some | (F.col("k") > 0), row("ordered_upc", w_o=few, w_o_large=many, w_c=F.col("k"), w_a=F.col("k_answered")))
    picked = F.when(some | (F.col("c") > 0), row("picked_upc", w_p=few, w_p_large=many, w_s=F.col("c")))
    used = stats.select(BUCKET, by, F.explode(F.array(ordered, picked)).alias("x")).where("x IS NOT NULL").select(BUCKET, by, "x.*")
    used = used.groupBy(BUCKET, "upc", by).agg(*[F.sum(n).alias(n) for n in (*weights, *large)]).select(
        "upc", by, *weights, *large)
    # a product key that is null can never match, so it is dropped
    both = F.array(*[F.struct(F.col(c).alias("upc"), F.lit(g).cast("bigint").alias("g"), F.lit(b).cast("bigint").alias("b"))
                     for c, g, b in (("con_upc_no", 1, None), ("bas_con_upc_no", None, 1))])
    known = products.select(F.explode(both).alias("x")).select("x.*").where("upc IS NOT NULL")
    met = used.unionByName(known, allowMissingColumns=True).repartition("upc")
    counts = met.groupBy("upc", by).agg(*[F.sum(n).alias(n) for n in (*weights, *large, "g", "b")])
    same = Window.partitionBy("upc")
    return counts.withColumns({n: F.sum(n).over(same) for n in ("g", "b")}).where(F.col(by).isNotNull())
