"""Column expressions shared by operators and reports.

Everything here is a built-in Catalyst expression, so it stays inside
whole-stage codegen; nothing calls back into Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from subrecon.functions.values import (
    CLICK_ACCEPTED,
    CLICK_REJECTED,
    NO,
    RESPONSE_ACCEPT,
    RESPONSE_REJECT,
    YES,
)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def presence_flag(c: str | Column) -> Column:
    """'NO' when the value is null, else 'YES' (never null itself)."""
    return F.when(_col(c).isNull(), F.lit(NO)).otherwise(F.lit(YES))


def accept_vs_rejected(status: str | Column = "status",
                       sub_status: str | Column = "sub_status") -> Column:
    """Response says Accept while the clickstream says rejected."""
    return (_col(status) == RESPONSE_ACCEPT) & (_col(sub_status) == CLICK_REJECTED)


def reject_vs_accepted(status: str | Column = "status",
                       sub_status: str | Column = "sub_status") -> Column:
    """Response says Reject while the clickstream says accepted."""
    return (_col(status) == RESPONSE_REJECT) & (_col(sub_status) == CLICK_ACCEPTED)


def is_contradiction(status: str | Column = "status",
                     sub_status: str | Column = "sub_status") -> Column:
    """The two sources give opposite answers for the same substitution.

    Null or unknown statuses are never a contradiction (three-valued logic
    makes the disjunction null, which ``where`` drops).
    """
    return accept_vs_rejected(status, sub_status) | reject_vs_accepted(status, sub_status)


def answer_class(status: str | Column = "status",
                 sub_status: str | Column = "sub_status") -> Column:
    """Cell of the response x click answer matrix; ``other`` for the rest."""
    s, c = _col(status), _col(sub_status)
    return (
        F.when((s == RESPONSE_ACCEPT) & (c == CLICK_REJECTED), F.lit("accept_vs_rejected"))
        .when((s == RESPONSE_REJECT) & (c == CLICK_ACCEPTED), F.lit("reject_vs_accepted"))
        .when((s == RESPONSE_ACCEPT) & (c == CLICK_ACCEPTED), F.lit("accept_vs_accepted"))
        .when((s == RESPONSE_REJECT) & (c == CLICK_REJECTED), F.lit("reject_vs_rejected"))
        .otherwise(F.lit("other"))
    )


def percent(numerator: str | Column, denominator: str | Column) -> Column:
    """numerator / denominator * 100 as an unrounded DOUBLE.

    Null when the denominator is 0 or null (``try_divide``), instead of the
    ANSI division-by-zero error. Rounding is left to presentation
    (``rounded``), so stored figures stay exact IEEE results.
    """
    ratio = F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))
    return ratio * F.lit(100.0)


def rounded(c: str | Column, places: int = 2) -> Column:
    """Half-up rounding for display, as the printed figures use."""
    return F.round(_col(c), places)


def count_where(cond: Column) -> Column:
    """Number of rows where ``cond`` is true, as BIGINT (0 on no rows)."""
    return F.coalesce(F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("bigint")


#: Counts that are multiplied or summed over multiplied counts: exact up to 38 digits.
COUNT = "decimal(38,0)"
MAX_BIGINT = (1 << 63) - 1


def exact(c: str | Column) -> Column:
    """A count as a number whose products do not overflow BIGINT."""
    return _col(c).cast(COUNT)


def published(c: str | Column, metric: str) -> Column:
    """An exact count as the BIGINT that reports show; fails, naming the metric, if it is larger."""
    v = _col(c)
    too_large = F.raise_error(F.lit(f"metric {metric}: the count exceeds BIGINT")).cast("bigint")
    return F.when(v > F.lit(str(MAX_BIGINT)).cast(COUNT), too_large).otherwise(v.cast("bigint"))


def at_least_one(c: str | Column) -> Column:
    """Rows a left outer join emits for a left row with ``c`` partners."""
    return F.greatest(_col(c), F.lit(1))


def none_to_one(c: str | Column) -> Column:
    """1 when there are no partners, else 0: the null-extended outer row."""
    return F.when(_col(c) == 0, F.lit(1)).otherwise(F.lit(0))
