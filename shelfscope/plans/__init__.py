"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfscope.plans import catalogue, extraction, flows, market, names, stores

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (market, catalogue, extraction, stores, names, flows)


def queries() -> dict[str, Query]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
