"""Scans of parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table ``name`` under ``root``, a file or a folder of part files."""
    return spark.read.parquet(f"{root}/{name}.parquet")
