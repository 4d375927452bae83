"""Catalogue of the runnable queries and their DuckDB check queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def r6(column: str | Column, name: str | None = None) -> Column:
    """Six decimals, the precision results are compared at; written out so that ties round alike everywhere."""
    col = F.col(column) if isinstance(column, str) else column
    return (F.floor(col * 1e6 + 0.5) / F.lit(1e6)).alias(name or column)


def r6_sql(*columns: str) -> str:
    return ", ".join(f"{r6_of(c)} as {c}" for c in columns)


def r6_of(expression: str) -> str:
    return f"floor(({expression})::double * 1e6 + 0.5) / 1e6"


def joined(column: str, name: str | None = None) -> Column:
    """Array shown as comma-joined text."""
    return F.array_join(column, ",").alias(name or column)
