"""All queries of the core, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.plans import crossession, decisions, geometry, models, selective, shapes, signals, stats, streams, tables, training

_PARTS = [training, crossession, stats, signals, geometry, streams, models, decisions, selective, tables, shapes]
FLAGSHIP = selective.unit_feature_significance


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in _PARTS for name, f in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.oracle_sql().items()}
