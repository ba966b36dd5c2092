"""Deliver a shard's records to a handler in batches (batch and stream form).

A batch holds at most ``batch_size`` consecutive records of one shard
(``batch = floor(offset / batch_size)``), so a batch never mixes shards and
its size is bounded: collecting one batch into an array or a pandas frame is
safe at any scale. Two handler forms:

* native: the batch is an event ``Records ARRAY<STRUCT<kinesis STRUCT<data STRING>>>``
  (plus offsets) and the handler is a Column function over it, all in the JVM;
* Python: ``handler(pdf) -> pdf`` called once per batch through
  ``mapInArrow`` (no per-row Python); the frame has Arrow-backed columns, so wide
  integers, nulls and decimals arrive as they are.

In a stream, ``foreachBatch`` hands every micro-batch to the same code.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardline.operators.ordered import KeyRuns
from shardline.session import ship_package


def with_batch(df: DataFrame, batch_size: int = 1, offset: str = "offset", out: str = "batch") -> DataFrame:
    if int(batch_size) < 1:
        raise ValueError("batch_size must be >= 1")
    return df.withColumn(out, F.expr(f"`{offset}` div {int(batch_size)}").cast("bigint"))


def batch_events(df: DataFrame, batch_size: int = 1, shard: str = "partition", offset: str = "offset",
                 data: str = "value") -> DataFrame:
    """One row per (shard, batch) with the handler event ``Records`` in offset
    order, plus ``first_offset``/``last_offset``/``n_records``.

    The grouping uses a partial aggregation; each group holds at most
    ``batch_size`` records, so the collected array is bounded."""
    b = with_batch(df, batch_size, offset)
    if int(batch_size) == 1:
        # every record is its own batch: build the event per row, no shuffle
        return b.select(shard, "batch", F.col(offset).alias("first_offset"), F.col(offset).alias("last_offset"),
                        F.lit(1).cast("bigint").alias("n_records"),
                        F.array(F.struct(F.struct(F.col(data).alias("data")).alias("kinesis"))).alias("Records"))
    rec = F.struct(F.col(offset).alias("offset"), F.struct(F.col(data).alias("data")).alias("kinesis"))
    g = b.groupBy(shard, "batch").agg(F.array_sort(F.collect_list(rec)).alias("_sl_recs"),
                                      F.min(offset).alias("first_offset"),
                                      F.max(offset).alias("last_offset"),
                                      F.count(F.lit(1)).alias("n_records"))
    return (g.withColumn("Records", F.transform("_sl_recs", lambda r: F.struct(r["kinesis"].alias("kinesis"))))
             .drop("_sl_recs"))


def apply_native(events: DataFrame, handler: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """Run a Column handler over each batch event: ``handler(Records)``
    returns named result columns."""
    outs = handler(F.col("Records"))
    return events.select("*", *[c.alias(n) for n, c in outs.items()]).drop("Records")


def _run_python(handler, keys: list[str], value_schema: pa.Schema):
    """Call ``handler`` once per (shard, batch) run of consecutive rows.

    Rows arrive sorted by (shard, batch, offset), so each batch is a
    contiguous slice; a batch cut by an Arrow batch boundary is carried over
    (at most ``batch_size`` rows). The handler returns a dict (one output
    row) or a DataFrame (any rows); outputs are assembled and the shard and
    batch columns attached once per input Arrow batch."""
    def emit(table: pa.Table, starts: list[int]):
        pdf = table.to_pandas(types_mapper=pd.ArrowDtype)
        rows, frames, counts = [], [], []
        for lo, hi in zip(starts, starts[1:]):
            res = handler(pdf.iloc[lo:hi])
            (rows if isinstance(res, dict) else frames).append(res)
            counts.append(1 if isinstance(res, dict) else len(res))
        if rows and frames:
            raise TypeError("a handler must return either dicts or DataFrames, not both")
        if frames:
            values = pa.concat_tables([pa.Table.from_pandas(f[value_schema.names], value_schema, preserve_index=False)
                                       for f in frames])
        else:
            values = pa.Table.from_pylist(rows, value_schema)
        first = pa.array(np.repeat(starts[:-1], counts), pa.int64())
        out = pa.Table.from_arrays([*(table.column(k).take(first) for k in keys), *values.columns],
                                   [*keys, *value_schema.names])
        yield from out.combine_chunks().to_batches()

    def run(batches):
        pending = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (pa.concat_tables([pending, table]) if pending is not None else table).combine_chunks()
            if not table.num_rows:
                continue
            starts = np.flatnonzero(KeyRuns(keys).starts(table)).tolist()
            # the last run may continue in the next Arrow batch
            if len(starts) > 1:
                yield from emit(table, starts)
            pending = table.slice(starts[-1])
        if pending is not None and pending.num_rows:
            yield from emit(pending, [0, pending.num_rows])
    return run


def handle_batches(df: DataFrame, handler: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType,
                   batch_size: int = 1, shard: str = "partition", offset: str = "offset") -> DataFrame:
    """Call a Python ``handler`` once per batch of one shard. The handler gets
    the batch as a pandas DataFrame in offset order and returns a dict (one
    output row) or a DataFrame; ``schema`` is its output schema (without the
    shard and batch columns, which are added). Rows are hash-partitioned on (shard, batch), so a hot shard still
    spreads over all tasks, and sorted so batches are contiguous."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    b = with_batch(df, batch_size, offset)
    # one record per batch needs no grouping; larger batches are brought
    # together by a hash exchange on (shard, batch) and sorted
    keyed = b if int(batch_size) == 1 else b.repartition(shard, "batch").sortWithinPartitions(shard, "batch", offset)
    fields = [keyed.schema[shard], keyed.schema["batch"]] + list(schema.fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    ship_package(df.sparkSession)
    return keyed.mapInArrow(_run_python(handler, [shard, "batch"], to_arrow_schema(schema)), T.StructType(fields))
