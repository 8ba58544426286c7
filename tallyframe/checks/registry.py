"""All registered queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyframe.checks import aggregates, files, joins, projections, scalars, shapes
from tallyframe.checks.base import Check, Query, plain

SECTIONS = (files, projections, scalars, aggregates, joins, shapes)


def _registered() -> dict[str, Check]:
    found: dict[str, Check] = {}
    for section in SECTIONS:
        for name, check in section.CHECKS.items():
            if name in found:
                raise ValueError(f"two queries are called {name}")
            found[name] = check
    return found


def _run(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: plain(query(spark, folder))


def reports() -> dict[str, Query]:
    """The queries with results in their own types."""
    return {name: check.run for name, check in _registered().items()}


def queries() -> dict[str, Query]:
    return {name: _run(check.run) for name, check in _registered().items()}


def oracle_sql() -> dict[str, str]:
    return {name: check.sql for name, check in _registered().items() if check.sql}
