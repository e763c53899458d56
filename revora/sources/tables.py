"""Reading the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet``, be it one file or a folder of files."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
