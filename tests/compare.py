"""Compare catalog queries with their DuckDB oracle: rows, columns, values."""

from __future__ import annotations

import datetime as dt
import math
import os
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import SparkSession

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "item"):  # numpy scalar
        return _norm(v.item())
    return v


def _rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@dataclass
class Outcome:
    name: str
    spark_rows: int
    oracle_rows: int
    columns_match: bool
    values_match: bool
    detail: str = ""

    @property
    def ok(self) -> bool:
        return self.columns_match and self.values_match and self.spark_rows == self.oracle_rows


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in DRIVER_TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark: SparkSession, sf_dir: str, name: str, query, sql: str, con=None) -> Outcome:
    con = con or duckdb_connection(sf_dir)
    df = query(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    o_cols = [d[0] for d in cur.description]
    o_rows = cur.fetchall()
    cols_ok = sorted(s_cols) == sorted(o_cols)
    detail = ""
    if not cols_ok:
        detail = f"columns spark-only {sorted(set(s_cols) - set(o_cols))} oracle-only {sorted(set(o_cols) - set(s_cols))}"
        vals_ok = False
    else:
        a, b = _rows(s_cols, s_rows), _rows(o_cols, o_rows)
        vals_ok = a == b
        if not vals_ok:
            only_s = list((a - b).elements())[:3]
            only_o = list((b - a).elements())[:3]
            detail = f"spark-only {only_s} oracle-only {only_o}"
    return Outcome(name, len(s_rows), len(o_rows), cols_ok, vals_ok, detail)
