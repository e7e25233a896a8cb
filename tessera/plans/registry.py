"""All named queries of the engine and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import analytics, basics, changes, context, extraction, graphs, quality, search, storage  # noqa: F401
from tessera.plans.base import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["impact_of_suppliers"](spark, sf_dir)
