"""Structured Streaming jobs: function mappings with handler swap, reader
groups, retention windows, member sessions, flush policy.

All state lives in checkpoint folders below the shared ``spark.checkpoint.dir``;
a stopped or crashed job resumes from its checkpoint with nothing lost, and
sinks are idempotent per micro-batch (see :mod:`shardline.streaming.runs`).
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from typing import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardline.session import drop_staged, exists, hadoop_path, staged
from shardline.sources.topic_log import read_topic
from shardline.streaming.handlers import batch_events
from shardline.streaming.runs import Observed, batch_sink, read_sink, run_available, to_event_time, to_wall_clock

Handler = Callable[[DataFrame], DataFrame]


class StaleRevision(ValueError):
    """Someone else has changed the mapping since."""


class FunctionMapping:
    """A stream mapped to a handler. ``start`` processes what has arrived with
    the current handler; ``swap`` replaces the handler: the running query is
    stopped and restarted on the **same checkpoint**, so records after the
    last committed micro-batch go to the new handler and none are lost. Each
    output row carries the handler version and the micro-batch id.

    ``start_at="latest"`` begins with the records that arrive after the mapping
    was made. Beside the checkpoint lies a record of each revision of the mapping, numbered 1,
    2, ..., with the handler version it brought in. A swap names the revision it is based on
    (by default the one this object knows) and creates the next record, which only one of
    several processes can; the others are refused before anything runs. A restarted
    process finds revision and version there (``current``).

    With a ``batch_size`` the handler gets batch events (see
    :class:`BatchDelivery`), one row per whole batch of one shard; what is left
    in open batches is delivered by ``close``."""

    def __init__(self, source: Callable[[], DataFrame], checkpoint: str, out: str, *, start_at: str = "earliest",
                 batch_size: int | None = None, window_seconds: int = 0):
        if start_at not in ("earliest", "latest"):
            raise ValueError("start_at is earliest or latest")
        self.source, self.checkpoint, self.out = source, checkpoint, out
        self.handler: Handler | None = None
        self.spark = SparkSession.active()
        self.records = f"{checkpoint}-revisions"
        self.revision, self.version = self.current()
        self.batches = (BatchDelivery(f"{checkpoint}-open", out, batch_size, self._versioned, window_seconds)
                        if batch_size else None)
        if start_at == "latest":
            skip_available(source(), checkpoint)

    def _versioned(self, df: DataFrame) -> DataFrame:
        return self.handler(df).withColumn("handler_version", F.lit(int(self.version)))

    def current(self) -> tuple[int, int | None]:
        """(revision, handler version) of the newest record; (0, None) before the first start."""
        path, fs = hadoop_path(self.spark, self.records)
        newest = max((int(x.getPath().getName()) for x in fs.listStatus(path)), default=0) if fs.exists(path) else 0
        if not newest:
            return 0, None
        return newest, int(self.spark.read.text(f"{self.records}/{newest}", wholetext=True).first()["value"])

    def _claim(self, revision: int, version: int) -> None:
        """Create the record of the revision after ``revision``, or fail."""
        if self.current()[0] != revision:
            raise StaleRevision(f"the mapping is at revision {self.current()[0]}, not {revision}")
        path, fs = hadoop_path(self.spark, f"{self.records}/{revision + 1}")
        try:
            record = fs.create(path, False)
        except Py4JJavaError as error:
            if not fs.exists(path):
                raise
            raise StaleRevision(f"revision {revision + 1} has just been made by another process") from error
        record.write(bytearray(str(int(version)).encode()))
        record.close()
        self.revision = revision + 1

    def _run(self, handler: Handler, version: int) -> "FunctionMapping":
        self.handler, self.version = handler, int(version)
        sink = self.batches.sink if self.batches else batch_sink(self.out, lambda df, _: self._versioned(df))
        run_available(self.source(), self.checkpoint, sink)
        return self

    def start(self, handler: Handler, version: int) -> "FunctionMapping":
        """Process what has arrived. A mapping that was started before goes on with the
        version it has."""
        revision, known = self.current()
        if known is None:
            self._claim(0, version)
        elif int(version) != known:
            raise StaleRevision(f"the mapping has handler version {known}; another one needs a swap")
        else:
            self.revision = revision
        return self._run(handler, version)

    def swap(self, handler: Handler, version: int, revision: int | None = None) -> "FunctionMapping":
        """Replace the handler of revision ``revision``; the new one needs a higher version."""
        based_on = self.revision if revision is None else int(revision)
        known = self.current()[1]
        if known is not None and int(version) <= known:
            raise StaleRevision(f"a new handler needs a higher version than {known}")
        self._claim(based_on, version)
        return self._run(handler, version)

    def close(self, spark: SparkSession, now: datetime | None = None) -> None:
        """Hand over the open batches whose window has passed."""
        self.batches.close(spark, now)


def skip_available(stream: DataFrame, checkpoint: str) -> None:
    """Start a checkpoint at the end of what has arrived ("latest"): one run whose
    plan is an always-false filter, so the file source marks every file as processed
    without reading it."""
    run_available(stream.filter(F.lit(False)), checkpoint, lambda df, batch_id: None)


class GroupReader:
    """A named reader group on a topic log: its position is its own
    checkpoint, so each ``poll`` continues where the group stopped and other
    groups are unaffected. Output lands in ``group=<g>/batch_id=<n>``, where the
    checkpoint numbers the batches: a replayed one overwrites itself, also after a
    restart of the process."""

    def __init__(self, spark: SparkSession, topic_path: str, group: str, root: str, out: str,
                 max_files_per_trigger: int | None = None):
        self.spark, self.topic_path, self.group = spark, topic_path, group
        self.checkpoint = f"{root}/{group}"
        self.out, self.max_files = out, max_files_per_trigger

    def _stream(self) -> DataFrame:
        return read_topic(self.spark, self.topic_path, "earliest", stream=True, max_files_per_trigger=self.max_files)

    def seek_latest(self) -> None:
        """Start the group at the end of the log."""
        skip_available(self._stream(), self.checkpoint)

    def poll(self, handler: Handler | None = None) -> None:
        def transform(df: DataFrame, batch_id: int) -> DataFrame:
            return (handler(df) if handler else df).withColumn("group_id", F.lit(self.group))
        run_available(self._stream(), self.checkpoint, batch_sink(f"{self.out}/group={self.group}", transform))


class BatchDelivery:
    """Whole shard batches out of a stream, as a ``foreachBatch`` sink.

    A batch is ``batch_size`` consecutive records of one shard. Each micro-batch is
    joined by the records that the one before left open; batches that are complete
    now are handed to ``handler`` as events (``handlers.batch_events``) and written to
    ``out/batch_id=<n>``, the others to the open table of micro-batch n. Nothing is
    ever late: a shard that runs behind is only completed later. Both folders are
    overwritten when micro-batch n is replayed, from the same inputs, so every record
    is delivered once. The open table holds the incomplete batches only, so its size
    depends on shards and batch size, not on the length of the log.

    ``close`` hands over incomplete batches that have been open for
    ``window_seconds`` (the batching window)."""

    def __init__(self, root: str, out: str, batch_size: int, handler: Handler, window_seconds: int = 0,
                 shard: str = "partition", offset: str = "offset", data: str = "value"):
        self.root, self.out, self.batch_size, self.handler = root, out, int(batch_size), handler
        self.window = timedelta(seconds=window_seconds)
        self.names = {shard: "partition", offset: "offset", data: "value"}

    def _versions(self, spark: SparkSession) -> list[tuple[int, int]]:
        """(micro-batch, times closed since) of the open tables that are kept."""
        path, fs = hadoop_path(spark, self.root)
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(tuple(map(int, n.split("-"))) for n in names)  # a few: old ones are removed

    def _open(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        found = [v for v in self._versions(spark) if v[0] == batch_id]
        return spark.read.parquet(f"{self.root}/{found[-1][0]}-{found[-1][1]}") if found else None

    def _deliver(self, rows: DataFrame, batch_id: int) -> None:
        (self.handler(batch_events(rows, self.batch_size))
         .write.mode("overwrite").parquet(f"{self.out}/batch_id={batch_id}"))

    def _split(self, rows: DataFrame, chosen) -> DataFrame:
        return staged(rows.dropDuplicates(["partition", "offset"]).withColumn("chosen", chosen), "batch-delivery")

    def _per_batch(self):
        # a batch has batch_size records, so the window's groups are small
        return Window.partitionBy("partition", F.expr(f"offset div {self.batch_size}"))

    def sink(self, df: DataFrame, batch_id: int) -> None:
        spark, now = df.sparkSession, datetime.now(timezone.utc)
        rows = df.select(*(F.col(k).alias(v) for k, v in self.names.items())).withColumn("since", F.lit(now))
        before = self._open(spark, batch_id - 1)
        if before is not None:
            rows = before.unionByName(rows)
        rows = self._split(rows, F.count(F.lit(1)).over(self._per_batch()) == self.batch_size)
        self._deliver(rows.filter("chosen").drop("chosen", "since"), batch_id)
        if (batch_id, 1) not in self._versions(spark):  # else a replay after a close, which took part of it
            rows.filter("NOT chosen").drop("chosen").write.mode("overwrite").parquet(f"{self.root}/{batch_id}-0")
        drop_staged(rows)
        for n, k in self._versions(spark):
            if n < batch_id - 1:
                path, fs = hadoop_path(spark, f"{self.root}/{n}-{k}")
                fs.delete(path, True)

    def close(self, spark: SparkSession, now: datetime | None = None) -> None:
        """Deliver the incomplete batches whose window has passed at ``now``. What a
        close after micro-batch n delivers has a negative batch id of its own, and the
        open table a new version."""
        versions = self._versions(spark)
        if not versions:
            return
        n, k = versions[-1]
        passed = F.lit((now or datetime.now(timezone.utc)) - self.window)
        rows = self._split(self._open(spark, n), F.min("since").over(self._per_batch()) <= passed)
        due = rows.filter("chosen").drop("chosen", "since")
        if not due.isEmpty():
            self._deliver(due, -(n * 1024 + k + 1))
            rows.filter("NOT chosen").drop("chosen").write.mode("overwrite").parquet(f"{self.root}/{n}-{k + 1}")
        drop_staged(rows)


def handle_batches_stream(stream: DataFrame, checkpoint: str, out: str, batch_size: int, handler: Handler,
                          window_seconds: int = 0) -> BatchDelivery:
    """Stream form of batch delivery: run what has arrived through whole batches of
    ``batch_size`` records of one shard. Call ``close`` on the result to hand over
    incomplete batches once their window has passed."""
    delivery = BatchDelivery(f"{checkpoint}-open", out, batch_size, handler, window_seconds)
    run_available(stream, checkpoint, delivery.sink)
    return delivery


def hourly_counts(stream: DataFrame, ts: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Records per event-time window, emitted once the window is closed;
    records arriving behind the watermark (older than ``late`` behind the
    newest event time seen) are dropped (retention on a stream)."""
    ev = to_event_time(stream, ts).withWatermark(ts, late)
    g = ev.groupBy(F.window(ts, window)).agg(F.count(F.lit(1)).alias("n"))
    return g.select(to_wall_clock("window.start").alias("window_start"),
                    to_wall_clock("window.end").alias("window_end"), "n")


def retention_run(stream: DataFrame, ts: str, checkpoint: str, out: str, account: str, window: str = "1 hour",
                  late: str = "1 hour", flush_idle: bool = True) -> None:
    """Run :func:`hourly_counts` over what has arrived and keep account of it: the rows that each
    micro-batch read, and those of them without a time, are observed on the way and added to
    the ``account`` table; see :func:`retention_account`."""
    spark = stream.sparkSession
    seen = stream.observe("arrived", F.count(F.lit(1)).alias("n_read"), F.count(F.when(F.col(ts).isNull(), 1)).alias("n_untimed"))
    observed = Observed("arrived")
    spark.streams.addListener(observed)
    try:
        q = run_available(hourly_counts(seen, ts, window, late), checkpoint, batch_sink(out), stateful=True,
                          flush_idle=flush_idle)
        batches = observed.wait(q)
    finally:
        spark.streams.removeListener(observed)
    for batch, m in sorted(batches.items()):  # a few numbers per micro-batch; one that is replayed overwrites its own
        spark.range(1).select(F.lit(int(m["n_read"])).cast("bigint").alias("n_read"),
                              F.lit(int(m["n_untimed"])).cast("bigint").alias("n_untimed")).write.mode(
            "overwrite").parquet(f"{account}/batch_id={batch}")


def retention_account(spark: SparkSession, checkpoint: str, out: str, account: str) -> DataFrame:
    """One row: the rows read so far, those counted in windows that were emitted (``n_kept``),
    those in windows still open (in the state of the checkpoint), those without a time, and
    the rest, ``n_late``: rows that came behind the watermark."""
    read = spark.read.parquet(account).agg(F.sum("n_read").alias("n_read"), F.sum("n_untimed").alias("n_untimed"))
    sum_of = lambda df, c, name: df.agg(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name))
    kept = sum_of(read_sink(spark, out, "window_start timestamp_ntz, window_end timestamp_ntz, n long"), "n", "n_kept")
    state = sum_of(spark.read.format("statestore").load(checkpoint), "value.count", "n_open")
    # three rows of totals
    one = read.withColumn("n_kept", kept.scalar()).withColumn("n_open", state.scalar())
    return one.select("n_read", "n_kept", "n_open", "n_untimed",
                      (F.col("n_read") - F.col("n_kept") - F.col("n_open") - F.col("n_untimed")).alias("n_late"))


def member_sessions_stream(stream: DataFrame, member: str, ts: str, gap: str = "1 hour",
                           late: str = "1 hour", extra: list[str] | None = None) -> DataFrame:
    """Sessions of each member closed after ``gap`` of silence, emitted when
    the watermark passes the session end (append mode). Sessions of a hot member are
    merged inside each task before they meet with ``LOCAL_SESSION_MERGE``."""
    ev = to_event_time(stream, ts).withWatermark(ts, late)
    keys = [member, *(extra or [])]
    g = ev.groupBy(*keys, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n_events"))
    return g.select(*keys, to_wall_clock("session_window.start").alias("session_start"),
                    to_wall_clock("session_window.end").alias("session_end"), "n_events")


#: Merge session windows inside each task before the exchange; for ``run_available(conf=...)``.
LOCAL_SESSION_MERGE = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}


def distinct_stream(stream: DataFrame, cols: list[str], ts: str | None = None, late: str | None = None) -> DataFrame:
    """Streaming de-duplication. Without a horizon every distinct row appears once
    ever; the state is one entry per distinct row. With ``ts`` and ``late`` the state
    is bounded instead: a duplicate is dropped if it arrives within ``late`` of the
    first one, and appears again after that."""
    if late is None:
        return stream.select(*cols).dropDuplicates(cols)
    return to_event_time(stream, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(cols).select(*cols)


def flush_every(stream_writer, every: str | None = None, available_now: bool = False):
    """Trigger policy of a stream writer: a fixed interval (``every``, e.g.
    ``"1 second"``) or all available data then stop."""
    if available_now:
        return stream_writer.trigger(availableNow=True)
    return stream_writer.trigger(processingTime=every or "1 second")
