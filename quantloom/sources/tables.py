"""Readers for the Parquet tables that feed the panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table by name; only Spark's reader touches the path, so any Hadoop store works."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
