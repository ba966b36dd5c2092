"""Sinks: trace CSV appends and bounded gathers to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession

from shardline.sources.text_inputs import TRACE_SCHEMA

GATHER_MAX_ROWS = 100_000


def append_traces(df: DataFrame, path: str) -> None:
    """Append ``phase, framework, nodes, seconds`` rows to a trace folder as
    header-less CSV (each append adds files; nothing is rewritten)."""
    df.select("phase", "framework", "nodes", "seconds").write.mode("append").option("header", "false").csv(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACE_SCHEMA).option("header", "false").csv(path)


def gather(df: DataFrame, limit: int = GATHER_MAX_ROWS) -> list[Row]:
    """Bring a whole result to the caller. A result of more than ``limit`` rows is
    refused, never cut: write it, or take it in parts with ``toLocalIterator``."""
    if limit is None or int(limit) > GATHER_MAX_ROWS:
        raise ValueError(f"gather is bounded: at most {GATHER_MAX_ROWS} rows")
    rows = df.limit(int(limit) + 1).collect()
    if len(rows) > int(limit):
        raise ValueError(f"the result has more than {int(limit)} rows")
    return rows
