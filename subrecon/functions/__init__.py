"""Column expressions and fixed values."""

from subrecon.functions.expressions import (
    accept_vs_rejected,
    answer_class,
    at_least_one,
    count_where,
    is_contradiction,
    none_to_one,
    percent,
    presence_flag,
    reject_vs_accepted,
    rounded,
)
from subrecon.functions import values

__all__ = [
    "accept_vs_rejected",
    "answer_class",
    "at_least_one",
    "count_where",
    "is_contradiction",
    "none_to_one",
    "percent",
    "presence_flag",
    "reject_vs_accepted",
    "rounded",
    "values",
]
