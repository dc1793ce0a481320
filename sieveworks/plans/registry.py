"""Registered queries of the core package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveworks.plans import index_queries, scenarios, text_queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of the corpus after all checks."""
    return index_queries.q_scan_report(spark, sf_dir)


def queries() -> dict:
    return {**text_queries.QUERIES, **index_queries.QUERIES, **scenarios.QUERIES}


def oracle_sql() -> dict:
    return {**text_queries.ORACLE, **index_queries.ORACLE, **scenarios.ORACLE}
