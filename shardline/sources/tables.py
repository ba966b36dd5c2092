"""The driver tables (TPC-H-like star schema plus events and text tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table as a DataFrame; Catalyst prunes columns and pushes filters
    into the parquet scan, so callers select only what they need."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Temp views with the table names, for the SQL surface."""
    for name in names:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
