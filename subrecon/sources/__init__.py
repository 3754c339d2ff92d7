"""Input tables: contracts, Parquet loaders, periods, test-data stand-ins."""

from subrecon.sources.contracts import ContractError
from subrecon.sources.period import OPEN, Period, month_of
from subrecon.sources.tables import TABLES, Evidence, read_table, scope

__all__ = ["ContractError", "Evidence", "OPEN", "Period", "TABLES", "month_of",
           "read_table", "scope"]
