"""Queries over the driver tables, by name, each with the DuckDB SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import documents, extra, names, risk, sources, streams

_MODULES = (risk, documents, names, extra, sources, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, (f, _) in m.PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in _MODULES for k, (_, sql) in m.PLANS.items() if sql}
