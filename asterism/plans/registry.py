"""All registered queries of the engine, by name, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    catalogue,
    catalogue_enrich,  # noqa: F401  these register their queries
    catalogue_hub,  # noqa: F401
    catalogue_more,  # noqa: F401
    catalogue_phases,  # noqa: F401
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalogue.PLANS)


def oracle_sql() -> dict[str, str]:
    return dict(catalogue.ORACLES)
