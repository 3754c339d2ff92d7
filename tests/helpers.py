"""Literal-row inputs for micro tests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

from subrecon.sources.period import OPEN
from subrecon.sources.tables import Evidence

S = T.StringType()
SUBS = T.StructType([
    T.StructField("order_no", S), T.StructField("ordered_upc", S), T.StructField("picked_upc", S),
    T.StructField("store_code", S), T.StructField("attempted_utilization", T.DoubleType()),
    T.StructField("event_date", T.DateType()),
])
RESP = T.StructType([
    T.StructField("order_no", S), T.StructField("ordered_upc", S), T.StructField("picked_upc", S),
    T.StructField("store_code", S), T.StructField("status", S), T.StructField("division", T.LongType()),
    T.StructField("event_date", T.DateType()),
])
PARTNER = T.StructType([
    T.StructField("order_no", S), T.StructField("ordered_upc", S), T.StructField("picked_upc", S),
    T.StructField("has_sub", T.BooleanType()), T.StructField("event_date", T.DateType()),
])
CLICKS = T.StructType([
    T.StructField("order_id", S), T.StructField("upc", S), T.StructField("sub_upc", T.ArrayType(S)),
    T.StructField("sub_status", S), T.StructField("channel", S), T.StructField("sub_price", T.DoubleType()),
    T.StructField("event_date", T.DateType()),
])
TXNS = T.StructType([
    T.StructField("order_no", S), T.StructField("gtin_no", S), T.StructField("store_code", S),
    T.StructField("transaction_date", T.DateType()),
])
PRODUCTS = T.StructType([T.StructField("con_upc_no", S), T.StructField("bas_con_upc_no", S)])

D = dt.date(2024, 2, 10)


def sub(o, u, p, store="00001", util=0.5, d=D):
    return (o, u, p, store, util, d)


def resp(o, u, p, status="Accept", division=1, store="00001", d=D):
    return (o, u, p, store, status, division, d)


def partner(o, u, p, has_sub=True, d=D):
    return (o, u, p, has_sub, d)


def click(o, u, subs, status="accepted", channel="app", price=1.0, d=D):
    return (o, u, subs, status, channel, price, d)


def txn(o, g, store="00001", d=D):
    return (o, g, store, d)


def evidence(spark, subs=(), resps=(), partners=(), clicks=(), txns=(), products=(), period=OPEN):
    frames = {
        "substitution_events": spark.createDataFrame(list(subs), SUBS),
        "response_events": spark.createDataFrame(list(resps), RESP),
        "partner_events": spark.createDataFrame(list(partners), PARTNER),
        "clicks": spark.createDataFrame(list(clicks), CLICKS),
        "transactions": spark.createDataFrame(list(txns), TXNS),
        "products": spark.createDataFrame(list(products), PRODUCTS),
    }
    return Evidence.from_frames(frames, period)


def metrics(df) -> dict:
    return {r["metric"]: (r["numerator"], r["denominator"], r["percent"]) for r in df.collect()}
