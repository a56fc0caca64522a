"""Parquet tables of a scale directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.session import reach_workers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read ``<sf_dir>/<name>.parquet``; filters and column lists chained on it reach the scan."""
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
