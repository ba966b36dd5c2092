"""Ordered scans per key that never put one key into one task.

Positions (offsets), running sums and gap sessions are "per key, in order"
computations. A plain ``Window.partitionBy(key)`` sends every row of a key to
one task, so a key holding a third of the data becomes a third of the job on one
core. Here the rows are range-partitioned on ``(key, order)`` instead: a hot key
is cut into many contiguous slices, each slice is scanned locally, and a small
table of per-slice totals stitches the slices together. The work is one range
shuffle plus aggregates over that small table.

The scanned slices are written once as parquet to the shared folder before they
are read twice (totals and rows): a range exchange samples its bounds anew in
every plan, so two plans may cut different slices. The files are removed when the
application ends.

The local pass works on Arrow batches: columns pass through untouched, keys are
compared as they are, and sums stay in their own type (64-bit integers, decimals
exactly, doubles).

Joining the corrections back never shuffles the big side: a key needs one only in
the slices after its first, and each of the ``partitions - 1`` slice boundaries is
crossed by at most one key, so the correction table has fewer rows than there are
partitions.
"""

from __future__ import annotations

import decimal
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardline.functions.scalars import epoch_micros
from shardline.session import ship_package, staged

_PID = "_sl_pid"


def _cols(xs) -> list:
    if xs is None:
        return []
    if isinstance(xs, (str, Column)):
        return [xs]
    return list(xs)


def _names(xs) -> list[str]:
    return [x for x in _cols(xs) if isinstance(x, str)]


def _slices(df: DataFrame, keys, order, num_partitions) -> DataFrame:
    """Range-partition on (keys, order), sort each slice, tag slice id.

    Without an explicit count the exchange uses the shuffle partition count
    and AQE may merge adjacent small ranges (merged slices stay contiguous),
    so slice sizes follow the data volume."""
    by = _cols(keys) + _cols(order)
    ranged = df.repartitionByRange(int(num_partitions), *by) if num_partitions else df.repartitionByRange(*by)
    return ranged.sortWithinPartitions(*by).withColumn(_PID, F.spark_partition_id())


def _null_safe_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join the (bounded) per-slice table onto the rows by slice and key,
    broadcast: the big side keeps its slices and is not shuffled."""
    ren = {k: f"_sl_k_{i}" for i, k in enumerate(keys)}
    s = small
    for k, r in ren.items():
        s = s.withColumnRenamed(k, r)
    s = F.broadcast(s.withColumnRenamed(_PID, "_sl_p"))
    cond = big[_PID] == s["_sl_p"]
    for k, r in ren.items():
        cond = cond & big[k].eqNullSafe(s[r])
    return big.join(s, cond, how).drop("_sl_p", *ren.values())


def dense_index(df: DataFrame, keys, order, out: str = "idx", *, num_partitions: int | None = None,
                start: int = 0) -> DataFrame:
    """Add ``out`` = 0-based (or ``start``-based) position of each row within
    its key in ``order``; the same as ``row_number() - 1`` over
    ``Window.partitionBy(keys).orderBy(order)`` but without the one-task-per-key
    plan: an exclusive running count."""
    one = "_sl_one"
    res = prefix_sum(df.withColumn(one, F.lit(1).cast("bigint")), _names(keys), order, one, out,
                     num_partitions=num_partitions)
    return res.withColumn(out, (F.col(out) + F.lit(start)).cast("bigint")).drop(one)


# ---------------------------------------------------------------------------
# scanning Arrow batches


def _differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Element-wise "not the same value", where nulls are the same and so are NaNs."""
    same = pc.fill_null(pc.equal(a, b), False)
    same = pc.or_(same, pc.and_(pc.is_null(a, nan_is_null=True), pc.is_null(b, nan_is_null=True)))
    if pa.types.is_floating(a.type):  # a null is not a NaN
        same = pc.and_(same, pc.equal(pc.is_null(a), pc.is_null(b)))
    return ~same.to_numpy(zero_copy_only=False)


def _plain(a) -> pa.Array:
    """A comparable array: chunks joined, dictionaries decoded."""
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    return a.dictionary_decode() if pa.types.is_dictionary(a.type) else a


class KeyRuns:
    """Where key runs start, across the Arrow batches of one slice."""

    def __init__(self, keys: list[str]):
        self.keys, self.last = keys, None

    def starts(self, batch: pa.RecordBatch) -> np.ndarray:
        """Boolean per row: it opens a key run (the first row is compared with
        the last row of the batch before)."""
        new = np.zeros(batch.num_rows, bool)
        now = [_plain(batch.column(batch.schema.get_field_index(k))) for k in self.keys]
        for a in now:
            new[1:] |= _differs(a[1:], a[:-1])
        new[0] = self.last is None or any(_differs(a[:1], b)[0] for a, b in zip(now, self.last))
        self.last = [a[-1:] for a in now]
        return new


def _since_start(new: np.ndarray, running: np.ndarray, carry):
    """``running`` (totals before each row, from the batch's start) counted from
    the start of each row's key run; rows of the run carried over add ``carry``."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    out = running - running[first]
    if not new[0]:
        out[np.cumsum(new) == 0] += carry
    return out


# ---------------------------------------------------------------------------
# running sums


def _numbers(a: pa.Array) -> np.ndarray:
    """Values with nulls as 0: int64, float64, or exact decimals as objects."""
    if pa.types.is_decimal(a.type):
        return np.array([decimal.Decimal(0) if x is None else x for x in a.to_pylist()], dtype=object)
    return pc.fill_null(a, 0).to_numpy(zero_copy_only=False)


def _local_prefix_sum(keys: list[str], value: str, out: str, out_type: pa.DataType):
    def run(batches):
        runs, carry = KeyRuns(keys), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _numbers(_plain(batch.column(batch.schema.get_field_index(value))))
            new = runs.starts(batch)
            if v.dtype == object:
                before = np.array([decimal.Decimal(0), *accumulate(v)][:-1], dtype=object)
            else:
                before = np.cumsum(v) - v
            local = _since_start(new, before, carry)
            carry = local[-1] + v[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, out_type)], [*batch.schema.names, out])
    return run


def prefix_sum(df: DataFrame, keys, order, value: str, out: str, *,
               num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = sum of ``value`` over the rows of the same key strictly
    before this row in ``order`` (0 for the first row). Nulls count as 0.

    Equal to ``coalesce(sum(value) over (partition by keys order by order rows
    between unbounded preceding and 1 preceding), 0)``. The local pass reads each
    sorted slice as Arrow batches; the stitching is JVM. ``value`` keeps its type;
    the sum of integers is ``bigint``, of ``decimal(p, s)`` ``decimal(38, s)``, of
    other numbers ``double``."""
    from pyspark.sql.pandas.types import to_arrow_type

    ship_package(df.sparkSession)
    keys = _names(keys)
    cut = _slices(df, keys, order, num_partitions)
    vtype = cut.schema[value].dataType
    if isinstance(vtype, T.DecimalType):
        out_type = T.DecimalType(38, vtype.scale)
    else:
        out_type = T.DoubleType() if isinstance(vtype, (T.FloatType, T.DoubleType)) else T.LongType()
    local_name, summed = "_sl_local", "_sl_value"
    cut = cut.withColumn(summed, F.col(value).cast(out_type))
    schema = T.StructType(cut.schema.fields + [T.StructField(local_name, out_type, True)])
    local = staged(cut.mapInArrow(_local_prefix_sum(keys, summed, local_name, to_arrow_type(out_type)), schema),
                   "prefix-sum")
    zero = F.lit(0).cast(out_type)
    stats = local.groupBy(_PID, *keys).agg(F.coalesce(F.sum(summed).cast(out_type), zero).alias("_sl_tot"))
    before = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_sl_base", F.sum("_sl_tot").over(before).cast(out_type))
    # only a key continuing from an earlier slice needs a correction: fewer rows
    # than there are partitions
    fixes = stats.filter(F.col("_sl_base").isNotNull()).drop("_sl_tot")
    joined = _null_safe_join(local, fixes, keys, "left")
    return (joined.withColumn(out, (F.coalesce(F.col("_sl_base"), zero) + F.col(local_name)).cast(out_type))
                  .drop(_PID, "_sl_base", local_name, summed))


# ---------------------------------------------------------------------------
# gap sessions


def _local_sessions(keys: list[str], ts_us: str, gap_us: int):
    def run(batches):
        runs, last, carry = KeyRuns(keys), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            t = _plain(batch.column(batch.schema.get_field_index(ts_us))).to_numpy(zero_copy_only=False)
            new = runs.starts(batch)
            start = new.copy()
            start[1:] |= (t[1:] - t[:-1]) > gap_us
            if not new[0]:
                start[0] = t[0] - last > gap_us
            before = np.cumsum(start) - start
            opened = _since_start(new, before, carry) + start
            last, carry = t[-1], opened[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(opened, pa.int64())],
                                             [*batch.schema.names, "_sl_cum"])
    return run


def gap_sessions(df: DataFrame, keys, ts: str, gap_seconds: int, tiebreak=None, out: str = "session_no", *,
                 num_partitions: int | None = None) -> DataFrame:
    """Number the sessions of each key: a row opens a new session when it is
    the key's first row or follows the previous row by **more than** the gap
    (rows exactly one gap apart stay together, as ``session_window`` does).
    Adds ``out`` (1-based within the key). Hot keys are split across tasks.
    ``ts`` may be ``timestamp`` or ``timestamp_ntz``."""
    ship_package(df.sparkSession)
    keys = _names(keys)
    us, gap_us = "_sl_us", int(gap_seconds) * 1_000_000
    order = [ts] + _cols(tiebreak)
    # a row without a time belongs to no session
    untimed = df.filter(F.col(ts).isNull()).withColumn(out, F.lit(None).cast("bigint"))
    df = df.filter(F.col(ts).isNotNull())
    t = df.schema[ts].dataType
    src = df.withColumn(us, epoch_micros(ts) if isinstance(t, T.TimestampNTZType) else F.unix_micros(F.col(ts)))
    cut = _slices(src, keys, order, num_partitions)
    schema = T.StructType(cut.schema.fields + [T.StructField("_sl_cum", T.LongType(), False)])
    local = staged(cut.mapInArrow(_local_sessions(keys, us, gap_us), schema), "gap-sessions")
    stats = local.groupBy(_PID, *keys).agg(F.min(us).alias("_sl_first_us"), F.max(us).alias("_sl_last_us"),
                                           F.max("_sl_cum").alias("_sl_n"))
    w = Window.partitionBy(*keys).orderBy(_PID)
    stats = (stats
             .withColumn("_sl_prev_last", F.lag("_sl_last_us").over(w))
             # the slice's first row was counted as a start; undo it when the
             # previous slice of the same key ends within the gap
             .withColumn("_sl_fix", F.when(F.col("_sl_prev_last").isNotNull()
                                           & ((F.col("_sl_first_us") - F.col("_sl_prev_last")) <= F.lit(gap_us)),
                                           F.lit(-1)).otherwise(F.lit(0)))
             .withColumn("_sl_base", F.coalesce(F.sum(F.col("_sl_n") + F.col("_sl_fix")).over(
                 w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    # non-zero only for keys continuing from an earlier slice: fewer rows than
    # partitions (see prefix_sum)
    fixes = stats.filter((F.col("_sl_base") != 0) | (F.col("_sl_fix") != 0)).select(_PID, *keys, "_sl_fix", "_sl_base")
    joined = _null_safe_join(local, fixes, keys, "left")
    timed = (joined.withColumn(out, (F.coalesce(F.col("_sl_base"), F.lit(0)) + F.col("_sl_cum")
                                     + F.coalesce(F.col("_sl_fix"), F.lit(0))).cast("bigint"))
                   .drop(_PID, us, "_sl_cum", "_sl_fix", "_sl_base"))
    return timed.unionByName(untimed)
