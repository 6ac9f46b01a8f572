"""All evidence queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import registry
from .plans import q_aggregates, q_disk, q_graph, q_io, q_jobs, q_joins, q_scalars, q_verify  # noqa: F401  they register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: registry.oracle(name) for name in registry.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.QUERIES["agg_lineage_stats"](spark, sf_dir)
