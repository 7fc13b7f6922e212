"""The plan modules whose queries the entry point offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vacantia.plans import company_queries, metric_queries, review_queries, snapshot_queries, source_queries, text_queries, upkeep_queries, verdict_queries


def modules() -> list:
    """Every module of the core with QUERIES and ORACLES."""
    return [company_queries, metric_queries, text_queries, upkeep_queries, source_queries, snapshot_queries, verdict_queries, review_queries]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The query the smoke check runs."""
    return company_queries.tier_counts(spark, folder)
