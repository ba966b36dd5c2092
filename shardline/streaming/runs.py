"""Running streams to completion and idempotent batch sinks.

Streams here are started with ``trigger(availableNow=True)``: process all
that has arrived, in one or more micro-batches, then stop; the checkpoint
keeps the position for the next run (the same as a long-running trigger,
but testable). Outputs go through ``foreachBatch``, which is at-least-once:
every micro-batch overwrites its own folder ``batch_id=<n>``, so a replayed
batch replaces rather than duplicates its output.
"""

from __future__ import annotations

import threading
import time
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from shardline.functions.scalars import epoch_micros
from shardline.session import exists


_STARTING = threading.Lock()


def batch_sink(out: str, transform: Callable[[DataFrame, int], DataFrame] | None = None):
    """A ``foreachBatch`` function writing each micro-batch to ``out/batch_id=<n>``."""
    def write(df: DataFrame, batch_id: int) -> None:
        res = transform(df, batch_id) if transform else df
        res.write.mode("overwrite").parquet(f"{out}/batch_id={int(batch_id)}")
    return write


def state_partitions(spark: SparkSession) -> int:
    """State partitions for a new stateful stream: the shuffle partition
    count, but not more than the cores of the cluster (every micro-batch runs
    one task per state partition, so more only adds per-batch overhead)."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def run_available(stream: DataFrame, checkpoint: str, sink, *, output_mode: str = "append",
                  query_name: str | None = None, stateful: bool = False, flush_idle: bool = True,
                  conf: dict[str, str] | None = None) -> StreamingQuery:
    """Process everything available now, however long it takes, then return the ended
    query (one or more micro-batches).

    ``stateful``: start with :func:`state_partitions` state partitions (the
    started query keeps a copy of the session conf, and the count is then
    fixed in its checkpoint, so later restarts keep it).
    ``flush_idle=False``: no extra micro-batch only to emit what the advanced
    watermark closed; those results come out with the next arrival instead
    (a flush policy for runs that more data will follow). ``conf``: settings of this query.
    A query copies the session's settings when it starts; they are changed for that moment only
    and by one starting query at a time, so that the session and other queries keep theirs."""
    w = (stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).foreachBatch(sink))
    if query_name:
        w = w.queryName(query_name)
    spark = stream.sparkSession
    overrides = dict(conf or {})
    if stateful:
        overrides["spark.sql.shuffle.partitions"] = str(state_partitions(spark))
    if not flush_idle:
        overrides["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    with _STARTING:
        old = {k: spark.conf.get(k, None) for k in overrides}
        for k, v in overrides.items():
            spark.conf.set(k, v)
        try:
            q = w.start()
        finally:
            for k, v in old.items():
                if v is None:
                    spark.conf.unset(k)
                else:
                    spark.conf.set(k, v)
    try:
        q.awaitTermination()
    finally:
        if q.isActive:
            q.stop()
    return q


class Observed(StreamingQueryListener):
    """The metrics that ``DataFrame.observe(name, ...)`` gives per micro-batch of the queries
    that run while it listens."""

    def __init__(self, name: str):
        self.name, self.batches, self.last = name, {}, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if self.name in progress.observedMetrics:
            self.batches[str(progress.runId), progress.batchId] = progress.observedMetrics[self.name].asDict()
        self.last[str(progress.runId)] = progress.batchId

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.last.setdefault(str(event.runId), -1)
        self.ended = str(event.runId)

    def wait(self, query: StreamingQuery, seconds: float = 60) -> dict[int, dict]:
        """The metrics of an ended query by micro-batch; events arrive a little later than it ends."""
        until = time.monotonic() + seconds
        while getattr(self, "ended", None) != str(query.runId):
            if time.monotonic() > until:
                raise TimeoutError("the query's last event didn't arrive")
            time.sleep(0.02)
        return {batch: m for (run, batch), m in self.batches.items() if run == str(query.runId)}


def read_sink(spark: SparkSession, out: str, schema: str | None = None) -> DataFrame:
    """All micro-batch outputs (with ``batch_id``). A sink that was never written
    is empty when its ``schema`` is known; every other failure to read is raised."""
    if schema and not exists(spark, out):
        return spark.createDataFrame([], schema + ", batch_id int")
    reader = spark.read.schema(schema + ", batch_id int") if schema else spark.read
    return reader.parquet(out)


def drop_files(df: DataFrame, folder: str) -> None:
    """Add one drop of files to a folder that a file stream watches."""
    df.write.mode("append").parquet(folder)


_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def to_event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need ``timestamp``: turn a ``timestamp_ntz`` wall-clock time
    into the instant with the same epoch microseconds, whatever the session
    time zone (window and session boundaries are epoch-aligned)."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return df.withColumn(ts, F.timestamp_micros(epoch_micros(ts)))
    return df


def to_wall_clock(col) -> F.Column:
    """Back from an event-time ``timestamp`` to ``timestamp_ntz`` (inverse of
    :func:`to_event_time`, time-zone free)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.expr(_EPOCH_NTZ))
