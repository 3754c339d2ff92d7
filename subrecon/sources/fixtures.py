"""Stand-in inputs derived from the driver's TPC-H-like test tables.

The real inputs (substitution, response, partner events, clickstream,
register lines, product dimension) are not available, so each is derived
row by row from ``lineitem`` / ``part`` with integer arithmetic that Spark
and DuckDB evaluate alike. This module only produces rows in the schema the
job expects; it does none of the job's work, and no operator relies on how
these rows are made.

Abbreviations: k = l_orderkey, p = l_partkey, s = l_suppkey,
n = l_linenumber, q = CAST(l_quantity AS BIGINT),
G(x) = 13-digit zero-padded UPC string, ST = 5-digit store code of k % 50.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subrecon.sources.period import OPEN, Period
from subrecon.sources.tables import Evidence


def _g(x: str) -> str:
    return f"lpad(CAST({x} AS STRING), 13, '0')"


_Q = "CAST(l_quantity AS BIGINT)"
_ST = "lpad(CAST(l_orderkey % 50 AS STRING), 5, '0')"
_KEYS = [
    "CAST(l_orderkey AS STRING) AS order_no",
    f"{_g('l_partkey')} AS ordered_upc",
    f"{_g('l_partkey + 1 + l_suppkey % 3')} AS picked_upc",
]
_DATE = "CAST(l_shipdate AS DATE)"


def substitution_events(lineitem: DataFrame) -> DataFrame:
    return lineitem.where("l_returnflag IN ('A', 'R')").selectExpr(
        *_KEYS,
        f"{_ST} AS store_code",
        "l_quantity / 50 AS attempted_utilization",
        f"{_DATE} AS event_date",
    )


def response_events(lineitem: DataFrame) -> DataFrame:
    return lineitem.where(
        f"{_Q} % 3 <> 0 AND (l_returnflag IN ('A', 'R') OR {_Q} % 10 = 1)"
    ).selectExpr(
        *_KEYS,
        f"{_ST} AS store_code",
        f"CASE WHEN {_Q} % 4 = 0 THEN 'Reject' ELSE 'Accept' END AS status",
        f"CASE WHEN {_Q} = 50 THEN CAST(NULL AS BIGINT) WHEN {_Q} % 7 = 0 THEN CAST(540 AS BIGINT)"
        " ELSE CAST(1 + l_suppkey % 20 AS BIGINT) END AS division",
        f"{_DATE} AS event_date",
    )


def partner_events(lineitem: DataFrame) -> DataFrame:
    return lineitem.where(f"l_returnflag = 'N' AND {_Q} % 10 = 1").selectExpr(
        *_KEYS,
        "l_linenumber <= 4 AS has_sub",
        f"{_DATE} AS event_date",
    )


def _dup(cond: str) -> F.Column:
    """Row multiplier written as a generator (1 copy, or 2 when ``cond``)."""
    return F.explode(F.expr(f"CASE WHEN {cond} THEN array(0, 1) ELSE array(0) END"))


def clicks(lineitem: DataFrame) -> DataFrame:
    arr = (
        f"CASE {_Q} % 5 WHEN 0 THEN CAST(NULL AS ARRAY<STRING>)"
        " WHEN 1 THEN CAST(array() AS ARRAY<STRING>)"
        f" WHEN 2 THEN array({_g('l_partkey + 1')})"
        f" WHEN 3 THEN array({_g('l_partkey + 1')}, {_g('l_partkey + 2')})"
        f" ELSE array({_g('l_partkey + 1')}, {_g('l_partkey + 2')}, {_g('l_partkey + 3')}) END"
    )
    return (
        lineitem.where("l_linenumber <> 7")
        .withColumn("dup", _dup(f"{_Q} % 11 = 0"))
        .selectExpr(
            "CAST(l_orderkey AS STRING) AS order_id",
            f"{_g('l_partkey')} AS upc",
            f"{arr} AS sub_upc",
            "CASE l_linenumber % 3 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'rejected'"
            " ELSE 'accepted' END AS sub_status",
            "CASE WHEN l_linestatus = 'F' THEN 'app' ELSE 'web' END AS channel",
            "CASE WHEN l_partkey % 2 = 0 THEN 'Y' ELSE 'N' END AS allow_substitutes",
            "CAST(l_partkey % 4 AS INT) AS number_of_subs",
            "CASE l_partkey % 3 WHEN 0 THEN 'best_match' WHEN 1 THEN 'same_brand'"
            " ELSE CAST(NULL AS STRING) END AS substitute_method",
            "'Y' AS product_allow_substitutes",
            "'best_match' AS product_substitute_method",
            "concat('item ', CAST(l_partkey AS STRING)) AS sub_name",
            "l_extendedprice AS sub_price",
            "CASE WHEN l_partkey % 5 = 0 THEN 'WEIGHT' ELSE 'EACH' END AS sub_type",
            "'EA' AS sub_units",
            f"{_DATE} AS event_date",
        )
    )


def transactions(lineitem: DataFrame) -> DataFrame:
    return (
        lineitem.where(f"l_returnflag <> 'N' AND ({_Q} % 4 <> 0 OR {_Q} % 8 = 0)")
        .withColumn("dup", _dup(f"{_Q} % 13 = 0"))
        .selectExpr(
            "CAST(l_orderkey AS STRING) AS order_no",
            f"{_g('l_partkey + 1 + l_suppkey % 3')} AS gtin_no",
            f"{_ST} AS store_code",
            f"{_DATE} AS transaction_date",
        )
    )


def products(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        f"{_g('p_partkey')} AS con_upc_no",
        f"{_g('p_partkey - p_partkey % 10')} AS bas_con_upc_no",
    )


def fixture_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The six input tables derived from ``<sf_dir>/lineitem|part.parquet``."""
    li = spark.read.parquet(os.path.join(sf_dir, "lineitem.parquet"))
    part = spark.read.parquet(os.path.join(sf_dir, "part.parquet"))
    return {
        "substitution_events": substitution_events(li),
        "response_events": response_events(li),
        "partner_events": partner_events(li),
        "clicks": clicks(li),
        "transactions": transactions(li),
        "products": products(part),
    }


def fixture_evidence(spark: SparkSession, sf_dir: str, period: Period = OPEN) -> Evidence:
    return Evidence.from_frames(fixture_frames(spark, sf_dir), period)
