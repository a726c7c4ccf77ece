"""Rows spread evenly for work that takes long per row."""

from __future__ import annotations

from pyspark.sql import DataFrame

from marlgraph.runtime import ship


def spread(rows: DataFrame) -> DataFrame:
    """The rows in at least four partitions a core. A scan that has two or more a core stays as it is, so large inputs aren't shuffled."""
    ship(rows.sparkSession)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= 2 * cores else rows.repartition(4 * cores)
