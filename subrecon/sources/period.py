"""Reporting periods: inclusive calendar-day ranges."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _as_date(v: str | dt.date | None) -> dt.date | None:
    if v is None or isinstance(v, dt.date):
        return v
    return dt.date.fromisoformat(v)


@dataclass(frozen=True)
class Period:
    """Days ``start`` .. ``end``, both inclusive; ``None`` leaves a side open.

    The filter is written as ``c >= start AND c < end + 1 day`` on the raw
    column (date or timestamp), so Catalyst pushes both bounds into the
    Parquet scan and prunes date-partitioned layouts.
    """

    start: dt.date | None = None
    end: dt.date | None = None

    @classmethod
    def of(cls, start: str | dt.date | None = None, end: str | dt.date | None = None) -> "Period":
        s, e = _as_date(start), _as_date(end)
        if s is not None and e is not None and e < s:
            raise ValueError(f"period end {e} is before start {s}")
        return cls(s, e)

    @property
    def is_open(self) -> bool:
        return self.start is None and self.end is None

    def condition(self, column: str) -> Column | None:
        c = F.col(column)
        cond = None
        if self.start is not None:
            cond = c >= F.lit(self.start)
        if self.end is not None:
            upper = c < F.lit(self.end + dt.timedelta(days=1))
            cond = upper if cond is None else cond & upper
        return cond

    def apply(self, df: DataFrame, column: str) -> DataFrame:
        cond = self.condition(column)
        return df if cond is None else df.where(cond)

    @property
    def month(self) -> str | None:
        """``yyyy-MM`` if the period lies in one calendar month, else None."""
        s, e = self.start, self.end
        one = s is not None and e is not None and (s.year, s.month) == (e.year, e.month)
        return f"{s.year:04d}-{s.month:02d}" if one else None

    @property
    def folder(self) -> str:
        """The label as a folder name."""
        return self.label().replace("/", "_")

    def label(self) -> str:
        return f"{self.start or '..'}/{self.end or '..'}"


OPEN = Period()


def _labels(periods: Sequence[Period]) -> list[str]:
    return list(dict.fromkeys(p.label() for p in periods))


def numbers_of(column: str, periods: Sequence[Period]) -> Column:
    """Which of the given periods a day falls in, one row each (``explode``), as numbers that ``name_of`` names: periods
    may overlap, and a day outside all of them has none."""
    labels = _labels(periods)
    each = [F.when(F.lit(True) if p.is_open else p.condition(column), F.lit(labels.index(p.label()))) for p in periods]
    return F.explode(F.array_compact(F.array(*each)))


def name_of(number: str, periods: Sequence[Period]) -> Column:
    """The label of a period that ``numbers_of`` gave."""
    return F.element_at(F.array(*map(F.lit, _labels(periods))), F.col(number) + 1)


def month_of(column: str) -> Column:
    """Calendar month ``yyyy-MM`` of a date or timestamp column."""
    return F.date_format(F.col(column), "yyyy-MM")


def month_number(column: str | Column) -> Column:
    """Months since the year 0, which ``month_name`` names as ``month_of`` does."""
    return F.year(column) * 12 + F.month(column) - 1


def month_name(number: str) -> Column:
    """Calendar month ``yyyy-MM`` of a ``month_number``."""
    n = F.col(number)
    return F.date_format(F.make_date(F.floor(n / 12).cast("int"), F.pmod(n, F.lit(12)) + 1, F.lit(1)), "yyyy-MM")
