"""Reading the parquet tables of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name; columns and filters are pruned into the scan by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
