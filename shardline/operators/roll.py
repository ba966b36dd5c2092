"""Greedy rolls per key: a new segment begins with the record that no longer fits the open one.

A record opens a segment if it would bring the open one over ``max_bytes``, if that has
``max_count`` records already, or if it is more than ``max_micros`` later than the segment's
first record. Where the next segment begins depends on where this one did, so that a key is a
chain from its first record on. To follow it without one task per key:

1. The records are cut into contiguous slices (``ordered``), with positions and running sizes.
2. In each slice a jump table gives for every place where a segment could begin the last
   one that then begins in the slice, by doubling the jumps. From outside a slice
   can only be entered near its first record, within one segment's limits of it.
3. What these last segments take up gives the place where the next slice is entered: first the slice,
   by a table with one row per slice, then the place, by binary search in it. So each
   entry points to another one, some slices further.
4. The entries that the chain from the first record really takes are marked by doubling the
   pointers: after r rounds all within 2**r slices. There is one per slice at most.
5. Each slice, knowing its entry and how many segments there are before, numbers its own.

A key of a third of all records stays cut into many slices in every step. Tables sent to all
tasks have at most two rows per slice.

Records without size count 0 bytes, those without time never roll by time; equal order keys are
ordered by the remaining columns of ``order``; null keys are a key of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardline.operators.ordered import _PID, _local_prefix_sum, _slices
from shardline.session import drop_staged, ship_package, staged

_FAR = (1 << 62) - 1  # beyond all positions, sums and times
_NOW = -_FAR
_IDX, _BEFORE, _SIZE, _TIME, _KEY = "_sl_idx", "_sl_before", "_sl_size", "_sl_time", "_sl_key"
_LIMITS = ("to_bytes", "to_count", "to_time")


class Limits:
    """The limits of a segment, and jumps in a slice (arrays in order)."""

    def __init__(self, max_bytes: int | None, max_count: int | None, max_micros: int | None):
        self.bytes, self.count, self.micros = max_bytes, max_count, max_micros

    def ends(self, idx, before, time) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a segment that begins at these records lets in: running bytes up to, places below,
        times up to."""
        far = np.full(len(idx), _FAR)
        return (before + self.bytes if self.bytes is not None else far, idx + self.count if self.count is not None else far,
                np.where(time == _NOW, _FAR, time + self.micros) if self.micros is not None else far)

    @staticmethod
    def first_out(ends, idx, after, latest) -> np.ndarray:
        """The place in the slice of the first record that is not let in: ``after`` are running bytes with
        the record, ``latest`` the latest time so far; all rise."""
        return np.minimum(np.minimum(np.searchsorted(after, ends[0], "right"), np.searchsorted(idx, ends[1], "left")),
                          np.searchsorted(latest, ends[2], "right"))

    def jumps(self, idx, before, size, time) -> np.ndarray:
        """For every record: where the next segment begins if one begins here; len if behind the slice."""
        out = self.first_out(self.ends(idx, before, time), idx, before + size, np.maximum.accumulate(time))
        return np.maximum(out, np.arange(len(idx)) + 1)  # a record alone may be over the limit


def _last_starts(jump: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place the last one of its chain in the slice, and how many begin on the way."""
    n = len(jump)
    last, count, to = np.arange(n + 1), np.ones(n + 1, np.int64), np.append(jump, n)
    count[n] = 0
    while (to[:n] < n).any():
        inside = to < n
        last = np.where(inside, last[np.minimum(to, n)], last)
        count = count + np.where(inside, count[np.minimum(to, n)], 0)
        to = to[to]
    return last[:n], count[:n]


def _arrays(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [pdf[c].to_numpy(np.int64) for c in (_IDX, _BEFORE, _SIZE, _TIME)]


def _entries(limits: Limits):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(_IDX, ignore_index=True)
        idx, before, size, time = _arrays(pdf)
        ends = limits.ends(idx[:1], before[:1], time[:1])
        # a segment from outside lets in less than one that began with the slice's first record
        near = int(limits.first_out(ends, idx, before + size, np.maximum.accumulate(time))[0]) + 1
        at = np.arange(min(near, len(idx)) if idx[0] else 1)
        last, count = _last_starts(limits.jumps(idx, before, size, time))
        out = dict(zip(_LIMITS, limits.ends(idx[last[at]], before[last[at]], time[last[at]])))
        return pd.DataFrame({_KEY: pdf[_KEY].iloc[:1].repeat(len(at)).to_numpy(), _PID: pdf[_PID].iloc[0], _IDX: idx[at], "n": count[at], **out})
    return run


def _enter(limits: Limits):
    def run(entries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(_IDX, ignore_index=True)
        idx, before, size, time = _arrays(rows)
        at = limits.first_out([entries[c].to_numpy(np.int64) for c in _LIMITS], idx, before + size, np.maximum.accumulate(time))
        return pd.DataFrame({_KEY: entries[_KEY], _IDX: entries[_IDX], "to": idx[np.minimum(at, len(idx) - 1)], "n": entries["n"]})
    return run


def _numbered(limits: Limits, out: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(_IDX, "ascending")]))
        idx, before, size, time = (table.column(c).to_numpy().astype(np.int64) for c in (_IDX, _BEFORE, _SIZE, _TIME))
        entry, number = table.column("entry")[0].as_py(), table.column("number")[0].as_py()
        begins = np.zeros(len(idx), np.int64)
        if entry is not None:
            jump, at = limits.jumps(idx, before, size, time), int(entry - idx[0])
            while at < len(idx):  # one step per segment of the slice
                begins[at] = 1
                at = jump[at]
        return table.append_column(out, pa.array(number - 1 + np.cumsum(begins), pa.int64()))
    return run


def greedy_roll(df: DataFrame, key: str, order, *, size: str | None = None, max_bytes: int | None = None,
                max_count: int | None = None, time_us: str | Column | None = None, max_micros: int | None = None,
                out: str = "segment", num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 0, 1, 2, ...: the record's segment of its key, rolled greedily in ``order`` by the
    limits given. ``time_us`` are microseconds; by time, records are expected in its order (an earlier
    one never rolls)."""
    ship_package(df.sparkSession)
    limits = Limits(max_bytes, max_count, max_micros)
    t = (F.col(time_us) if isinstance(time_us, str) else time_us) if time_us is not None else F.lit(None)
    narrow = [_KEY, _PID, _IDX, _BEFORE, _SIZE, _TIME]
    cut = _slices(df, [key], order, num_partitions).withColumn(_KEY, F.col(key)).withColumn(
        _SIZE, F.coalesce(F.col(size), F.lit(0)).cast("bigint") if size else F.lit(0).cast("bigint")).withColumn(
        "_sl_one", F.lit(1).cast("bigint")).withColumn(_TIME, F.coalesce(t.cast("bigint"), F.lit(_NOW)))
    for value, name in ((_SIZE, _BEFORE), ("_sl_one", _IDX)):
        cut = cut.mapInArrow(_local_prefix_sum([key], value, name, pa.int64()),
                             T.StructType([*cut.schema.fields, T.StructField(name, T.LongType())]))
    local = staged(cut.drop("_sl_one"), "roll-slices")
    # one row per slice and key; a key of one slice needs no correction and no entry
    so_far = Window.partitionBy(_KEY).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    stats = staged(local.groupBy(_KEY, _PID).agg(F.sum(_SIZE).alias("bytes"), F.count("*").alias("rows"), F.max(_TIME).alias("time"))
                   .withColumn("bytes0", F.coalesce(F.sum("bytes").over(so_far), F.lit(0)))
                   .withColumn("rows0", F.coalesce(F.sum("rows").over(so_far), F.lit(0)))
                   .withColumn("time", F.max("time").over(Window.partitionBy(_KEY).orderBy(_PID)))
                   .withColumn("slices", F.count("*").over(Window.partitionBy(_KEY))), "roll-stats")
    many = stats.filter("slices > 1")  # at most two rows per slice
    fixes = many.select(F.col(_KEY).alias("fk"), F.col(_PID).alias("fp"), "bytes0", "rows0")
    same = F.col(_KEY).eqNullSafe(F.col("fk")) & (F.col(_PID) == F.col("fp"))
    rows = (local.join(F.broadcast(fixes), same, "left")
            .withColumn(_BEFORE, F.col(_BEFORE) + F.coalesce("bytes0", F.lit(0)))
            .withColumn(_IDX, F.col(_IDX) + F.coalesce("rows0", F.lit(0))).withColumn("_sl_many", F.col("fp").isNotNull())
            .drop("fk", "fp", "bytes0", "rows0"))
    path = _path(rows.filter("_sl_many").select(*narrow), many, limits)
    # per slice: where its first segment begins and the number of that; without one, the last number before
    upto = Window.partitionBy("pk").orderBy("pp")
    marks = many.select(F.col(_KEY).alias("pk"), F.col(_PID).alias("pp"), "rows0", "rows").join(
        path.select(F.col(_KEY).alias("mk"), F.col(_IDX).alias("entry"), "number", "n"),
        F.col("pk").eqNullSafe(F.col("mk")) & (F.col("entry") >= F.col("rows0")) & (F.col("entry") < F.col("rows0") + F.col("rows")), "left")
    marks = marks.withColumn("done", F.last(F.col("number") + F.col("n"), ignorenulls=True).over(upto)).select(
        "pk", "pp", "entry", F.coalesce("number", "done").alias("number"))
    told = rows.join(F.broadcast(marks), F.col(_KEY).eqNullSafe(F.col("pk")) & (F.col(_PID) == F.col("pp")), "left").drop("pk", "pp")
    told = told.withColumn("entry", F.when(F.col("_sl_many"), F.col("entry")).otherwise(F.lit(0).cast("bigint"))).withColumn(
        "number", F.coalesce("number", F.lit(0).cast("bigint")))
    final = T.StructType([*told.schema.fields, T.StructField(out, T.LongType())])
    return told.groupBy(_PID, _KEY).applyInArrow(_numbered(limits, out), final).select(*df.columns, out)


def _path(rows: DataFrame, many: DataFrame, limits: Limits) -> DataFrame:
    """(key, idx, number, n) of the entries that the chains take, and how many segments begin from there
    to the slice's end."""
    spark, kind = rows.sparkSession, rows.schema[_KEY].dataType.simpleString()
    rounds = many.agg(F.max("slices")).first()[0]
    if not rounds:
        return spark.createDataFrame([], f"{_KEY} {kind}, {_IDX} bigint, number bigint, n bigint")
    made = rows.groupBy(_PID, _KEY).applyInPandas(
        _entries(limits), f"{_KEY} {kind}, {_PID} int, {_IDX} bigint, n bigint, " + ", ".join(f"{c} bigint" for c in _LIMITS))
    made = staged(made, "roll-entries")
    # the slices of a key in order: not more than there are slices
    ahead = many.groupBy(F.col(_KEY).alias("sk")).agg(F.array_sort(F.collect_list(F.struct(
        F.col(_PID).alias("pid"), (F.col("bytes0") + F.col("bytes")).alias("bytes"), (F.col("rows0") + F.col("rows")).alias("rows"),
        "time"))).alias("ahead"))
    further = F.filter("ahead", lambda s: (s["pid"] > F.col(_PID)) & (
        (s["bytes"] > F.col("to_bytes")) | (s["rows"] > F.col("to_count")) | (s["time"] > F.col("to_time"))))
    aimed = made.join(F.broadcast(ahead), F.col(_KEY).eqNullSafe(F.col("sk"))).withColumn(
        "target", F.try_element_at(further, F.lit(1))["pid"]).drop("ahead", "sk")
    aims = aimed.filter("target IS NOT NULL").drop(_PID).withColumnRenamed("target", _PID)
    jump = staged(aims.groupBy(_PID, _KEY).cogroup(rows.groupBy(_PID, _KEY)).applyInPandas(
        _found_in(limits), f"{_KEY} {kind}, {_IDX} bigint, `to` bigint, n bigint"), "roll-jumps")
    marked = staged(made.filter(f"{_IDX} = 0").select(_KEY, _IDX, F.lit(0).cast("bigint").alias("number")), "roll-path")
    old, reach = [jump, marked], 1
    while reach < rounds:
        on = jump.select(F.col(_KEY).alias("jk"), F.col(_IDX).alias("ji"), "to", F.col("n").alias("more"))
        met = lambda left, at: left.join(on, F.col(_KEY).eqNullSafe(F.col("jk")) & (F.col(at) == F.col("ji")))
        marked = staged(marked.unionByName(met(marked, _IDX).select(
            _KEY, F.col("to").alias(_IDX), (F.col("number") + F.col("more")).alias("number"))).distinct(), "roll-path")
        far = jump.withColumnRenamed("to", "mid")
        jump = staged(met(far, "mid").select(_KEY, _IDX, "to", (F.col("n") + F.col("more")).alias("n")), "roll-jumps")
        old += [jump, marked]
        reach *= 2
    count = made.select(F.col(_KEY).alias("ck"), F.col(_IDX).alias("ci"), "n")
    path = staged(marked.join(count, F.col(_KEY).eqNullSafe(F.col("ck")) & (F.col(_IDX) == F.col("ci")))
                  .select(_KEY, _IDX, "number", "n"), "roll-marked")
    drop_staged(made, *old)
    return path


def _found_in(limits: Limits):
    enter = _enter(limits)

    def run(entries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if entries.empty:
            return pd.DataFrame({_KEY: entries[_KEY], _IDX: entries[_IDX], "to": entries[_IDX], "n": entries["n"]})
        return enter(entries, rows)
    return run
