"""Registered queries, each next to the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL its rows are checked by the tests alone."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def r6(column: str | Column) -> Column:
    """Doubles are compared after rounding to six places."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def joined(column: str | Column) -> Column:
    """Lists are compared as text."""
    return F.array_join(column, "|")
