"""Query registry: a Spark callable per name and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
# Both engines round to six digits. Decimal inputs put averages exactly on a
# rounding edge, where summation order would decide; the nudge moves them off it.
NUDGE = 2.3e-8

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def r6(*names: str) -> list[Column]:
    return [F.round(F.col(n) + NUDGE, 6).alias(n) for n in names]


def long6(*names: str) -> list[Column]:
    """``r6`` for results of very many rows: the arithmetic of the oracle's rounding, without a decimal per value."""
    return [(F.rint((F.col(n) + NUDGE) * 1e6) / 1e6 + 0.0).alias(n) for n in names]


def s6(*names: str) -> str:
    """The same rounding in SQL; adding zero removes a negative zero."""
    return ", ".join(f"round({n} + 2.3e-8, 6) + 0.0 AS {n}" for n in names)
