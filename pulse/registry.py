"""All queries of the engine and the SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulse.plans import content, events, forecast, volume

CATALOGUES = (volume.C, events.C, content.C, forecast.C)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for c in CATALOGUES for k, f in c.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for c in CATALOGUES for k, s in c.sql.items()}
