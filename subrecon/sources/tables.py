"""Loaders for the six input tables and the ``Evidence`` bundle.

Each loader is ``spark.read.parquet`` + contract check + period filter.
Nothing is read eagerly: the filter and the later column selections reach
the Parquet scan as ``PushedFilters`` / a pruned ``ReadSchema``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subrecon.sources import contracts as C
from subrecon.sources.period import OPEN, Period

TABLES = ("substitution_events", "response_events", "partner_events",
          "clicks", "transactions", "products")

# Which column carries the period for each table (products have none).
PERIOD_COLUMN = {
    "substitution_events": "event_date",
    "response_events": "event_date",
    "partner_events": "event_date",
    "clicks": "event_date",
    "transactions": "transaction_date",
}

CONTRACT = {
    "substitution_events": C.SUBSTITUTION_EVENTS,
    "response_events": C.RESPONSE_EVENTS,
    "partner_events": C.PARTNER_EVENTS,
    "clicks": C.CLICKS,
    "transactions": C.TRANSACTIONS,
    "products": C.PRODUCTS,
}


def scope(name: str, df: DataFrame, period: Period = OPEN, *, only_with_subs: bool = True) -> DataFrame:
    """Contract-check ``df`` as table ``name`` and restrict it to ``period``.

    * partner events keep only rows with ``has_sub`` when ``only_with_subs``
      (the partner feed is asked for fulfilled orders that had substitutions);
    * clicks are period-filtered only when they carry an ``event_date``
      (a clickstream extract is usually already cut to the period).
    """
    df = CONTRACT[name].check(df)
    if name == "clicks":
        C.check_sub_columns(df)
    pcol = PERIOD_COLUMN.get(name)
    if pcol is not None and pcol in df.columns:
        df = period.apply(df, pcol)
    if name == "partner_events" and only_with_subs:
        df = df.where(F.col("has_sub"))
    return df


def read_table(spark: SparkSession, name: str, path: str, period: Period = OPEN) -> DataFrame:
    """Read one input table from Parquet and scope it."""
    return scope(name, spark.read.parquet(path), period)


def _readable(spark: SparkSession, path: str) -> bool:
    """Whether Spark's own reader finds ``path``, in whichever file system it lies."""
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def table_paths(spark: SparkSession, base: str) -> dict[str, str]:
    """Path of each input table under ``base``: ``<table>``, or
    ``<table>.parquet`` where only that exists."""
    paths = {}
    for t in TABLES:
        p = f"{base.rstrip('/')}/{t}"
        paths[t] = p if _readable(spark, p) else p + ".parquet"
    return paths


@dataclass(frozen=True)
class Evidence:
    """The six scoped inputs of one reconciliation run."""

    substitution_events: DataFrame
    response_events: DataFrame
    partner_events: DataFrame
    clicks: DataFrame
    transactions: DataFrame
    products: DataFrame
    period: Period = OPEN

    @classmethod
    def from_frames(cls, frames: dict[str, DataFrame], period: Period = OPEN) -> "Evidence":
        missing = [t for t in TABLES if t not in frames]
        if missing:
            raise C.ContractError(f"missing input tables: {missing}")
        return cls(**{t: scope(t, frames[t], period) for t in TABLES}, period=period)

    @classmethod
    def read(cls, spark: SparkSession, paths: dict[str, str] | str, period: Period = OPEN) -> "Evidence":
        """``paths`` maps table name to a Parquet path, or is a directory
        holding one ``<table>`` folder/file per input (``<table>.parquet``
        is tried too)."""
        if isinstance(paths, str):
            paths = table_paths(spark, paths)
        frames = {t: spark.read.parquet(paths[t]) for t in TABLES}
        return cls.from_frames(frames, period)

    def with_period(self, period: Period) -> "Evidence":
        """Narrow every dated table to ``period`` (applied on top)."""
        upd = {}
        for t, pcol in PERIOD_COLUMN.items():
            df = getattr(self, t)
            upd[t] = period.apply(df, pcol) if pcol in df.columns else df
        return replace(self, period=period, **upd)
