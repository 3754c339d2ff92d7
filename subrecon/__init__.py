"""Substitution-response reconciliation as Spark DataFrame jobs.

Packages: ``sources`` (input contracts, loaders, periods), ``functions``
(column expressions and fixed values), ``operators`` (row-level relations),
``plans`` (per-key count tables, reports, the batch job), ``checks`` (SQL
for the correctness gate).
"""

__version__ = "0.1.0"
