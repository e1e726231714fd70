"""Registered queries: each is a function of (session, data folder) and, where SQL can say it, the SQL of the same result.

The SQL is written independently of the operators (naive theta joins, coordinate compression instead of
inclusion-exclusion, plain sorts instead of histograms), so agreement means something.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> dict[str, tuple[Query, str | None]]:
    from . import catalog, files, index, spatial, staging, streams, telemetry

    found: dict[str, tuple[Query, str | None]] = {}
    for module in (spatial, index, files, staging, catalog, telemetry, streams):
        found.update(module.QUERIES)
    return found
