"""Readers of parquet tables by folder, and of relational tables over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, *, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, options: dict[str, str] | None = None) -> DataFrame:
    """A table of an external database; with a partition column it is read in parallel ranges. Filters and columns are pushed into the scan."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).option("queryTimeout", "30")
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.options(**(options or {})).load()
