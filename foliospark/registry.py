"""All registered queries of the library proper with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.plans import queries as plans
from foliospark.plans import structured
from foliospark.plans.queries import Query


def queries() -> dict[str, Query]:
    return dict(structured.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(structured.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk statistics by language: tokens, sentence split, greedy pack and aggregation end to end."""
    return plans.chunk_statistics(spark, sf_dir)
