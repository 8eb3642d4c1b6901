"""Registered queries over the driver tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import body_queries, derive_queries, graph_queries, migrate_queries, record_queries, relation_queries, run_queries, state_queries, validate_queries, write_queries

MODULES = (record_queries, run_queries, graph_queries, derive_queries, relation_queries, validate_queries, write_queries, body_queries, migrate_queries, state_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.ORACLES.items()}
