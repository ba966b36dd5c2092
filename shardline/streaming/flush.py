"""Flush a stream by number or age, whichever comes first, with Spark's own state and timers.

The records of a key wait in a list state. An event-time timer fires when the watermark passes the
earliest of them; those up to the watermark then join the open flush in their order, and a flush
is emitted when it has ``messages`` records, when a record is more than ``millis`` later than its first
one, or when the watermark says that no record within ``millis`` can come any more. As nothing is
decided before the watermark has passed, the flushes don't depend on how the records were dealt
to micro-batches, and they are those of the batch form (``operators.topic.flush_batches``).

The state of a key holds the records of the watermark's delay and one open flush, in blocks: an entry of
the list is a batch of records as columns, and the flushes are found on columns too, as a call or a row
object per record is what takes the time. A replayed micro-batch starts from the state of the one before,
so every record is flushed once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shardline.functions.scalars import epoch_micros
from shardline.streaming.runs import to_event_time, to_wall_clock

#: The state store that timers and list states need; for ``run_available(conf=...)``.
STATE_CONF = {"spark.sql.streaming.stateStore.providerClass":
              "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


#: Records of one state entry or one emitted frame, at most.
BLOCK = 10_000


def _blocks(records: pd.DataFrame) -> Iterator[pd.DataFrame]:
    return (records.iloc[at:at + BLOCK] for at in range(0, len(records), BLOCK))


def _entry(records: pd.DataFrame) -> tuple[bytes]:
    return (pickle.dumps({c: records[c].to_numpy() for c in records}, pickle.HIGHEST_PROTOCOL),)


class CountOrTime(StatefulProcessor):
    """``fields`` are the record's columns, ``us`` its time in microseconds; ``order`` those that order
    records after it; ``keys`` the names of the key's columns."""

    def __init__(self, keys: list[str], fields: list[str], order: list[str], messages: int, millis: int):
        self.keys, self.fields, self.order = keys, fields, order
        self.messages, self.micros = messages, 1000 * millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "records binary")  # the open flush first, in order
        self.open = handle.getValueState("open", "flush bigint, n int")

    def _call_at(self, micros: int) -> None:
        self.handle.registerTimer(-(-int(micros) // 1000))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        earliest = None
        for part in rows:
            self.waiting.appendValue(_entry(part[self.fields]))
            first = part["us"].min()
            earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._call_at(earliest)
        return iter(())

    def _flushes(self, us: np.ndarray, passed: int) -> np.ndarray:
        """Where the flushes of records in order begin, and where the last one that is whole ends."""
        at = np.arange(len(us))
        after = np.minimum(at + self.messages, np.searchsorted(us, us + self.micros, "right"))
        whole = (after < len(us)) | (after - at >= self.messages) | (passed > us + self.micros)
        after, whole, begin = after.tolist(), whole.tolist(), [0]
        while begin[-1] < len(us) and whole[begin[-1]]:
            begin.append(after[begin[-1]])
        return np.array(begin)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.waiting.exists():
            return iter(())
        passed = 1000 * timerValues.getCurrentWatermarkInMs()
        number, n_open = self.open.get() if self.open.exists() else (0, 0)
        entries = [pickle.loads(data) for (data,) in self.waiting.get()]
        records = pd.DataFrame({c: np.concatenate([e[c] for e in entries]) for c in self.fields})
        flush, rest = records.iloc[:n_open], records.iloc[n_open:]
        ripe = rest["us"] <= passed
        later = rest[~ripe]
        ripe = rest[ripe].sort_values(["us", *self.order], kind="stable", na_position="first")
        ready = pd.concat([flush, ripe], ignore_index=True)
        begin = self._flushes(ready["us"].to_numpy(), passed)
        done, n_done = ready.iloc[:begin[-1]], len(begin) - 1
        flush = ready.iloc[begin[-1]:]
        if len(flush) or len(later):
            self.waiting.put([_entry(b) for b in _blocks(pd.concat([flush, later]))])
        else:
            self.waiting.clear()
        self.open.update((number + n_done, len(flush)))
        if len(flush):
            self._call_at(flush["us"].iloc[0] + self.micros + 1000)
        if len(later):
            self._call_at(later["us"].min())
        done = done.assign(flush=number + np.repeat(np.arange(n_done), np.diff(begin)), **dict(zip(self.keys, key)))
        return _blocks(done)

    def close(self) -> None:
        pass


_NUMBERS = (T.IntegralType, T.FractionalType, T.BooleanType, T.TimestampType, T.TimestampNTZType)


def _carried(column: Column, kind: T.DataType, name: str) -> tuple[list[Column], Column]:
    """Columns that pandas carries exactly, as it has no numbers that can be null and times of some
    centuries only, and the expression that gives the value back from them."""
    if not isinstance(kind, _NUMBERS) or isinstance(kind, T.DecimalType):
        return [column.alias(name)], F.col(name)
    value, back = column, F.col(name).cast(kind)
    if isinstance(kind, T.BooleanType):
        value = column.cast("int")
    elif isinstance(kind, T.FractionalType):
        back = F.coalesce(F.col(name), F.lit(float("nan"))).cast(kind)  # pandas gives back NaN as null
    elif isinstance(kind, T.TimestampType):
        value, back = F.unix_micros(column), F.timestamp_micros(name)
    elif isinstance(kind, T.TimestampNTZType):
        value, back = epoch_micros(column), to_wall_clock(F.timestamp_micros(name))
    there = f"{name}there"
    return [F.coalesce(value, F.lit(0)).alias(name), column.isNotNull().alias(there)], F.when(F.col(there), back)


def flush_stream(stream: DataFrame, key: str, ts: str, order: list[str], keep: list[str], messages: int, millis: int,
                 late: str = "1 hour") -> DataFrame:
    """Each record's ``key``, ``flush`` (0, 1, 2, ... per key), ``ts_us``, ``order`` and ``keep`` columns,
    emitted with its flush. Records without a time never ripen and are left out; those behind
    the watermark are dropped by Spark; nulls come first in the order. Run it with
    ``run_available(conf=STATE_CONF)``."""
    timed = to_event_time(stream.filter(F.col(ts).isNotNull()), ts).withWatermark(ts, late)
    columns = list(dict.fromkeys([*order, *keep]))
    parts = {c: _carried(F.col(c), timed.schema[c].dataType, f"c{i}") for i, c in enumerate(columns)}
    key_parts, key_back = _carried(F.col(key), timed.schema[key].dataType, "key")
    carried = [x for c in columns for x in parts[c][0]]
    rows = timed.select(*key_parts, F.col(ts).alias("at"), F.unix_micros(ts).alias("us"), *carried)
    kinds = {f.name: f for f in rows.schema}
    keys = [n for n in kinds if n.startswith("key")]
    fields = [n for n in kinds if n not in (*keys, "at")]
    ordered = [n for i, c in enumerate(columns) if c in order for n in (f"c{i}there", f"c{i}") if n in kinds]
    flush = T.StructField("flush", T.LongType())
    out = T.StructType([*(kinds[k] for k in keys), flush, *(T.StructField(n, kinds[n].dataType) for n in fields)])
    flushed = rows.groupBy(*keys).transformWithStateInPandas(
        CountOrTime(keys, fields, ordered, messages, millis), out, "Append", "EventTime")
    return flushed.select(key_back.alias(key), "flush", F.col("us").alias("ts_us"),
                          *(parts[c][1].alias(c) for c in columns))
