"""Queries by name, each with the DuckDB SQL that says the same over the raw tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers f(chain) under a name; sql follows the common table expressions of plans.oracle_tables."""

    def put(f):
        from chainloom.plans.oracle_tables import TABLES
        from chainloom.sources.chain import Chain

        QUERIES[name] = lambda spark, sf_dir: f(Chain(spark, sf_dir))
        if sql:
            ORACLES[name] = TABLES + sql
        return f

    return put


def load() -> None:
    from chainloom.operators import audit, fees, index, logs, lookup, sinks, traces, views  # noqa: F401
    from chainloom.functions import scalars  # noqa: F401
    from chainloom.streaming import live  # noqa: F401


load()
