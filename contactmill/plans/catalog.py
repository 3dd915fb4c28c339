"""Registry of queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill.plans.fixtures import PRELUDE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(name: str, sql: str | None = None, ctes: str = "", recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query; `sql` selects from the prelude's tables, `ctes` adds more of them, perhaps recursive ones."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            prelude = PRELUDE.replace("WITH", "WITH RECURSIVE", 1) if recursive else PRELUDE
            ORACLES[name] = prelude + (",\n" + ctes if ctes else "") + "\n" + sql
        return fn

    return register


def rounded(column: str | Column, name: str | None = None, digits: int = DIGITS) -> Column:
    """A double rounded for comparison; adding zero turns -0.0 into 0.0."""
    col = F.col(column) if isinstance(column, str) else column
    out = F.round(col.cast("double"), digits) + F.lit(0.0)
    label = name or (column if isinstance(column, str) else None)
    return out.alias(label) if label else out


def r6(expression: str, name: str, digits: int = DIGITS) -> str:
    """The SQL twin of `rounded`."""
    return f"round(CAST({expression} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS {name}"


def big(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"
