"""Reading the workbench's tables: one Parquet file or folder of files per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table of that name; Parquet carries the schema, so column pruning and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
