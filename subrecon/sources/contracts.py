"""Input contracts: the columns each evidence table must provide.

Checked once per load against the Parquet footer schema (no data is read),
so a renamed or retyped upstream column fails early with a clear message
instead of silently changing a join or a de-duplication.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

log = logging.getLogger(__name__)

STRING = (T.StringType,)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC = INTEGRAL + (T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
BOOLEAN = (T.BooleanType,)


class ContractError(ValueError):
    """An input table does not have the columns or types the job needs."""


@dataclass(frozen=True)
class Column:
    name: str
    types: tuple
    required: bool = True
    array_of: tuple | None = None  # element types when the column is an array


@dataclass(frozen=True)
class Contract:
    table: str
    columns: tuple[Column, ...]

    def check(self, df: DataFrame) -> DataFrame:
        """Return ``df`` unchanged after validating names and types."""
        fields = {f.name: f.dataType for f in df.schema.fields}
        problems = []
        for c in self.columns:
            dt = fields.get(c.name)
            if dt is None:
                if c.required:
                    problems.append(f"missing column {c.name!r}")
                continue
            if c.array_of is not None:
                if not isinstance(dt, T.ArrayType) or not isinstance(dt.elementType, c.array_of):
                    problems.append(f"{c.name!r} is {dt.simpleString()}, expected array of "
                                    + "/".join(t.__name__ for t in c.array_of))
            elif not isinstance(dt, c.types):
                problems.append(f"{c.name!r} is {dt.simpleString()}, expected "
                                + "/".join(t.__name__ for t in c.types))
        if problems:
            raise ContractError(f"{self.table}: " + "; ".join(problems))
        return df

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]


SUBSTITUTION_EVENTS = Contract("substitution_events", (
    Column("order_no", STRING),
    Column("ordered_upc", STRING),
    Column("picked_upc", STRING),
    Column("store_code", STRING),
    Column("attempted_utilization", NUMERIC),
    Column("event_date", TEMPORAL),
))

RESPONSE_EVENTS = Contract("response_events", (
    Column("order_no", STRING),
    Column("ordered_upc", STRING),
    Column("picked_upc", STRING),
    Column("store_code", STRING),
    Column("status", STRING),
    Column("division", INTEGRAL),
    Column("event_date", TEMPORAL),
))

PARTNER_EVENTS = Contract("partner_events", (
    Column("order_no", STRING),
    Column("ordered_upc", STRING),
    Column("picked_upc", STRING),
    Column("has_sub", BOOLEAN),
    Column("event_date", TEMPORAL),
))

CLICKS = Contract("clicks", (
    Column("order_id", STRING),
    Column("upc", STRING),
    Column("sub_upc", (), array_of=STRING),
    Column("sub_status", STRING),
    Column("channel", STRING, required=False),
    Column("allow_substitutes", STRING, required=False),
    Column("number_of_subs", INTEGRAL, required=False),
    Column("substitute_method", STRING, required=False),
    Column("product_allow_substitutes", STRING, required=False),
    Column("product_substitute_method", STRING, required=False),
    Column("sub_name", STRING, required=False),
    Column("sub_price", NUMERIC, required=False),
    Column("sub_type", STRING, required=False),
    Column("sub_units", STRING, required=False),
    Column("event_date", TEMPORAL, required=False),
))

TRANSACTIONS = Contract("transactions", (
    Column("order_no", STRING),
    Column("gtin_no", STRING),
    Column("store_code", STRING),
    Column("transaction_date", TEMPORAL),
))

PRODUCTS = Contract("products", (
    Column("con_upc_no", STRING),
    Column("bas_con_upc_no", STRING),
))


def check_sub_columns(df: DataFrame) -> list[str]:
    """Clickstream columns containing 'sub' that the contract does not pin.

    The clickstream projection keeps every column whose name contains 'sub',
    so such a column changes the whole-row de-duplication. It is kept (the
    selection rule is part of the analysis) but reported. Any such column
    that is an array (besides ``sub_upc``) is rejected: it would be carried
    whole onto every exploded substitute instead of pairing with it.
    """
    pinned = set(CLICKS.names)
    extra = [c for c in df.columns if "sub" in c and c not in pinned]
    arrays = [f.name for f in df.schema.fields
              if "sub" in f.name and f.name != "sub_upc" and isinstance(f.dataType, T.ArrayType)]
    if arrays:
        # exploding sub_upc alone would cross a parallel array with every element
        raise ContractError(f"clicks: array columns {arrays} would lose their pairing with sub_upc")
    if extra:
        log.warning("clicks: unpinned columns containing 'sub' enter de-duplication: %s", extra)
    return extra
