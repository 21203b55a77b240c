"""Queries over the driver's tables, one or more for each operator, with the DuckDB SQL that checks them."""

from __future__ import annotations

from . import aggregation, builds, marts, relational, scalars

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (relational, aggregation, scalars, marts, builds):
    if _both := QUERIES.keys() & _module.Q.queries.keys():
        raise ValueError(f"registered twice: {sorted(_both)}")
    QUERIES |= _module.Q.queries
    ORACLE_SQL |= _module.Q.oracle
