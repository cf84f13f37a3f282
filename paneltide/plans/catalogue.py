"""The query catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paneltide.plans import model_queries, panel_queries, portfolio_queries, store_queries, stress_queries  # noqa: F401  they register their queries
from paneltide.plans.registry import ORACLE, QUERIES, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_queries.flagship(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
