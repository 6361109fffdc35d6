"""All queries of the reference's operators, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnwright.plans import queries_data  # noqa: F401
from turnwright.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of conversations, their first assistant message classified, labels counted."""
    return QUERIES["g2_turn_label_counts"](spark, sf_dir)
