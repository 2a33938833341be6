"""The catalogue: each query's DataFrame function and its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.plans import documents, manuscripts, pages, resolved, scalar, tex

MODULES = (scalar, documents, manuscripts, pages, tex, resolved)  # each adds its queries to scalar.Q and scalar.O


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(scalar.Q)


def oracle_sql() -> dict[str, str]:
    return dict(scalar.O)
