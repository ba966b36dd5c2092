"""The SQL and user-function surface.

* ``run_sql`` runs Spark SQL over DataFrames and values bound to this one call; no
  dialect of our own and no names left in the session.
* ``vectorized`` wraps a Python function of pandas Series as a Pandas UDF
  (Arrow batches, never row at a time); ``apply_batches`` ships a function of
  pandas DataFrames over each partition (``mapInPandas``). Closures are
  pickled by PySpark; no source text is shipped.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_sql(spark: SparkSession, frames: dict[str, DataFrame], sql: str, args: dict | None = None) -> DataFrame:
    """``sql`` names a frame as ``{name}`` and a value as ``:name``. Both are bound to this
    call: the session gets no view, so that calls with the same names, at the same time
    or one after the other, don't see each other's, and a value is never part of the text."""
    return spark.sql(sql, args=args or {}, **frames)


def vectorized(fn: Callable[[pd.Series], pd.Series], return_type: str):
    """A scalar Pandas UDF from a function of Series."""
    return F.pandas_udf(fn, return_type)


def apply_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run ``fn`` on every Arrow batch of every partition."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)
    return df.mapInPandas(run, schema)
