"""Distributed collections."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def parallelize(spark: SparkSession, source: int | Iterable, partitions: int | None = None) -> DataFrame:
    """A frame with one column ``value``: the integers below ``source``, made by the
    executors, or the items of a driver collection."""
    if isinstance(source, int):
        ids = spark.range(source) if partitions is None else spark.range(0, source, 1, partitions)
        return ids.withColumnRenamed("id", "value")
    items = list(source)
    df = spark.createDataFrame([(x,) for x in items], ["value"]) if items else spark.createDataFrame([], "value long")
    return df if partitions is None else df.repartition(partitions)
