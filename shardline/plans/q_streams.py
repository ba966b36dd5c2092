"""Queries for the topic log and streams: write/read topic, latest start,
stream batches, handler swap, reader groups, retention windows, sessions,
flush policy (operators 2, 3, 7, 18, 20-24, 39).

Each query writes its inputs (topic log, file drops) below the shared
checkpoint folder, runs real Structured Streaming queries with
``availableNow`` triggers and returns the sink table read back.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from shardline.functions.scalars import decode_payload, epoch_micros
from shardline.operators.ordered import gap_sessions
from shardline.operators.topic import assign_shard
from shardline.plans.catalog import query
from shardline.plans.fixtures import N_SHARDS, TOPIC_SQL, topic_records
from shardline.session import shared_path
from shardline.sources.tables import load
from shardline.sources.topic_log import TOPIC_COLUMNS, read_topic, write_topic
from shardline.streaming import jobs
from shardline.streaming.flush import STATE_CONF, flush_stream
from shardline.streaming.runs import batch_sink, drop_files, read_sink, run_available

N_DROPS = 4
GAP_SECONDS = 3600


def _ntz(us: int):
    """A literal wall-clock time, so that bounds reach the parquet scan."""
    t = datetime(1970, 1, 1) + timedelta(microseconds=us)
    return F.expr(f"TIMESTAMP_NTZ'{t.isoformat(sep=' ')}'")


def _time_drops(df, ts: str, k: int):
    """Split rows into ``k`` drops of equal event-time width, rows without a time in
    the last one; the bounds are one small aggregate row."""
    mn, mx = df.agg(F.min(epoch_micros(ts)), F.max(epoch_micros(ts))).first()
    if mn is None:  # no times: all rows in the last drop
        return [df.filter(F.lit(False))] * (k - 1) + [df]
    width = int(mx) - int(mn) + 1
    at = [int(mn) + -(-i * width // k) for i in range(k + 1)]
    drops = [df.filter((F.col(ts) >= _ntz(lo)) & (F.col(ts) < _ntz(hi))) for lo, hi in zip(at, at[1:-1])]
    return drops + [df.filter((F.col(ts) >= _ntz(at[-2])) | F.col(ts).isNull())]


def _drop_sql(k: int, ts: str = "ts", table: str = "events") -> str:
    return (f"((epoch_us({ts}) - (SELECT min(epoch_us({ts})) FROM {table})) * {k}) // "
            f"((SELECT max(epoch_us({ts})) - min(epoch_us({ts})) + 1 FROM {table}))")


def _marked_drops(ev, k: int):
    """Drops with a marker row three hours after the newest event at the end: it
    advances the watermark so the last real windows and sessions close. A column of
    its own tells it from the events."""
    marker = ev.agg(F.max("ts").alias("ts")).select(
        *((F.col("ts") + F.expr("INTERVAL 3 HOURS") if c == "ts" else F.lit(None).cast(ev.schema[c].dataType)).alias(c)
          for c in ev.columns), F.lit(True).alias("is_marker"))
    return [d.withColumn("is_marker", F.lit(False)) for d in _time_drops(ev, "ts", k)] + [marker]


# -- 7, 2, 3: topic log ----------------------------------------------------------

@query("write_topic", f"WITH {TOPIC_SQL} SELECT topic, partition, \"offset\", key, value, timestamp FROM topic_o")
def q_write_topic(spark, sf_dir):
    """Produce events to a topic log in two appends; offsets continue per shard."""
    path = shared_path(spark, "topic")
    first, second = _time_drops(topic_records(spark, sf_dir), "timestamp", 2)
    write_topic(first, path, "events", N_SHARDS, order=["timestamp", "event_id"])
    write_topic(second, path, "events", N_SHARDS, order=["timestamp", "event_id"])
    return read_topic(spark, path)


@query("write_topic_stream", f"WITH {TOPIC_SQL} SELECT topic, partition, \"offset\", key, value, timestamp FROM topic_o")
def q_write_topic_stream(spark, sf_dir):
    """A stream producer: event records arrive in two drops and each
    micro-batch becomes one batch of the log."""
    from shardline.sources.topic_log import produce_stream
    root = shared_path(spark, "producer")
    folder, path = f"{root}/in", f"{root}/topic"
    recs = topic_records(spark, sf_dir)
    sink = produce_stream(path, "events", N_SHARDS, order=["timestamp", "event_id"])
    for drop in _time_drops(recs, "timestamp", 2):
        drop_files(drop, folder)
        run_available(spark.readStream.schema(recs.schema).parquet(folder), f"{root}/ckpt", sink)
    return read_topic(spark, path)


@query("read_topic", f"WITH {TOPIC_SQL} SELECT topic, partition, \"offset\", key, value, timestamp FROM topic_o")
def q_read_topic(spark, sf_dir):
    """A reader group subscribed from the earliest record, as a stream."""
    path = shared_path(spark, "topic")
    write_topic(topic_records(spark, sf_dir), path, "events", N_SHARDS, order=["timestamp", "event_id"])
    root = shared_path(spark, "stream")
    reader = jobs.GroupReader(spark, path, "g1", f"{root}/groups", f"{root}/out")
    reader.poll()
    return read_sink(spark, f"{root}/out").select(*TOPIC_COLUMNS)


@query("read_topic_latest", f"""
WITH {TOPIC_SQL}
SELECT topic, partition, "offset", key, value, timestamp FROM topic_o WHERE {_drop_sql(2, "timestamp", "topic_o")} = 1
""")
def q_read_topic_latest(spark, sf_dir):
    """A reader group mapped with ``latest`` sees only records produced after
    the mapping (the existing files are skipped without being read)."""
    path = shared_path(spark, "topic")
    first, second = _time_drops(topic_records(spark, sf_dir), "timestamp", 2)
    write_topic(first, path, "events", N_SHARDS, order=["timestamp", "event_id"])
    root = shared_path(spark, "stream")
    reader = jobs.GroupReader(spark, path, "late", f"{root}/groups", f"{root}/out")
    reader.seek_latest()                                # the mapping is made here
    write_topic(second, path, "events", N_SHARDS, order=["timestamp", "event_id"])
    reader.poll()
    return read_sink(spark, f"{root}/out").select(*TOPIC_COLUMNS)


# -- 18 (stream form) --------------------------------------------------------------

WINDOW_BATCH = 10
BATCHES_SQL = f"""
WITH {TOPIC_SQL}
SELECT partition, "offset" // {WINDOW_BATCH} AS batch, count(*) AS n_records, min("offset") AS first_offset,
       max("offset") AS last_offset, CAST(sum(octet_length(encode(e.props))) AS BIGINT) AS payload_bytes
FROM topic_o t JOIN events e USING (event_id) GROUP BY partition, "offset" // {WINDOW_BATCH}
"""


def _payload_handler(events):
    sizes = F.transform("Records", lambda r: F.octet_length(decode_payload(r["kinesis"]["data"])))
    return events.select("partition", "batch", "n_records", "first_offset", "last_offset",
                         F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("payload_bytes"))


@query("handle_batches_stream", BATCHES_SQL)
def q_handle_batches_stream(spark, sf_dir):
    """Topic records streamed, a few files per micro-batch, to a native handler in
    whole shard batches of 10."""
    path = shared_path(spark, "topic")
    write_topic(topic_records(spark, sf_dir), path, "events", N_SHARDS, order=["timestamp", "event_id"])
    root = shared_path(spark, "stream")
    stream = read_topic(spark, path, stream=True, max_files_per_trigger=3)
    jobs.handle_batches_stream(stream, f"{root}/ckpt", f"{root}/out", WINDOW_BATCH, _payload_handler).close(spark)
    return read_sink(spark, f"{root}/out").drop("batch_id")


@query("handle_batches_window", BATCHES_SQL)
def q_handle_batches_window(spark, sf_dir):
    """Shard batches that stay whole although the producer appends in two
    rounds: a batch cut by the append is completed by the second run and
    delivered once; each shard's last, incomplete batch is delivered when its
    one-hour batching window has passed."""
    path = shared_path(spark, "topic")
    root = shared_path(spark, "wbatch")
    for part in _time_drops(topic_records(spark, sf_dir), "timestamp", 2):
        write_topic(part, path, "events", N_SHARDS, order=["timestamp", "event_id"])
        delivery = jobs.handle_batches_stream(read_topic(spark, path, stream=True), f"{root}/ckpt", f"{root}/out",
                                              WINDOW_BATCH, _payload_handler, window_seconds=3600)
        delivery.close(spark)  # no window has passed yet
    delivery.close(spark, datetime.now(timezone.utc) + timedelta(hours=1))
    return read_sink(spark, f"{root}/out").drop("batch_id")


# -- 20: handler swap ----------------------------------------------------------------

@query("swap_handler", f"""
SELECT event_id, CAST(CASE WHEN {_drop_sql(2)} = 0 THEN 1 ELSE 2 END AS INTEGER) AS handler_version,
       CASE WHEN {_drop_sql(2)} = 0 THEN event_type ELSE upper(event_type) END AS result
FROM events
""")
def q_swap_handler(spark, sf_dir):
    """Events arrive in two drops; handler 1 sees the first, then the
    handler is swapped and handler 2 sees the rest: nothing lost or repeated."""
    ev = load(spark, sf_dir, "events")
    root = shared_path(spark, "swap")
    folder = f"{root}/in"
    first, second = _time_drops(ev, "ts", 2)
    drop_files(first, folder)
    mapping = jobs.FunctionMapping(lambda: spark.readStream.schema(ev.schema).parquet(folder),
                                   f"{root}/ckpt", f"{root}/out")
    mapping.start(lambda df: df.select("event_id", F.col("event_type").alias("result")), version=1)
    drop_files(second, folder)
    mapping.swap(lambda df: df.select("event_id", F.upper("event_type").alias("result")), version=2)
    return read_sink(spark, f"{root}/out").select("event_id", "handler_version", "result")


@query("map_function_latest", f"""
WITH {TOPIC_SQL}, late AS (SELECT * FROM topic_o WHERE {_drop_sql(2, "timestamp", "topic_o")} = 1)
SELECT partition, "offset" // {WINDOW_BATCH} AS batch, count(*) AS n_records, min("offset") AS first_offset,
       max("offset") AS last_offset, CAST(sum(octet_length(encode(e.props))) AS BIGINT) AS payload_bytes,
       1 AS handler_version
FROM late t JOIN events e USING (event_id) GROUP BY partition, "offset" // {WINDOW_BATCH}
""")
def q_map_function_latest(spark, sf_dir):
    """A function mapped to a topic with start position ``latest`` and batches of 10:
    only records produced after the mapping are handed over."""
    path, root = shared_path(spark, "topic"), shared_path(spark, "mapping")
    first, second = _time_drops(topic_records(spark, sf_dir), "timestamp", 2)
    write_topic(first, path, "events", N_SHARDS, order=["timestamp", "event_id"])
    mapping = jobs.FunctionMapping(lambda: read_topic(spark, path, stream=True), f"{root}/ckpt", f"{root}/out",
                                   start_at="latest", batch_size=WINDOW_BATCH)
    write_topic(second, path, "events", N_SHARDS, order=["timestamp", "event_id"])
    mapping.start(_payload_handler, version=1).close(spark)
    return read_sink(spark, f"{root}/out").drop("batch_id")


# -- 21: reader groups -------------------------------------------------------------

@query("resume_group", f"""
WITH {TOPIC_SQL}, d AS (SELECT partition, "offset", {_drop_sql(2, "timestamp", "topic_o")} AS drop_no FROM topic_o)
SELECT 'a' AS group_id, CAST(drop_no + 1 AS INTEGER) AS run, partition, "offset" FROM d
UNION ALL
SELECT 'b', 1, partition, "offset" FROM d
""")
def q_resume_group(spark, sf_dir):
    """Group ``a`` reads after each of two produce rounds and resumes where
    it stopped; group ``b`` reads once at the end from its own position."""
    path = shared_path(spark, "topic")
    root = shared_path(spark, "groups")
    first, second = _time_drops(topic_records(spark, sf_dir), "timestamp", 2)
    a = jobs.GroupReader(spark, path, "a", f"{root}/ckpt", f"{root}/out")
    b = jobs.GroupReader(spark, path, "b", f"{root}/ckpt", f"{root}/out")
    write_topic(first, path, "events", N_SHARDS, order=["timestamp", "event_id"])
    a.poll()
    write_topic(second, path, "events", N_SHARDS, order=["timestamp", "event_id"])
    a.poll()
    b.poll()
    out = spark.read.parquet(f"{root}/out")
    # each poll found one produce round, so the batch's number tells the run
    return out.select("group_id", (F.col("batch_id") + 1).alias("run"), "partition", "offset")


# -- 22: retention on a stream -------------------------------------------------------

@query("retention_stream", """
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
       count(*) AS n
FROM events GROUP BY 1, 2
""")
def q_retention_stream(spark, sf_dir):
    """Events in four time-ordered drops and a closing marker; hourly counts
    with a one-hour watermark, emitted as windows close."""
    ev = load(spark, sf_dir, "events")
    root = shared_path(spark, "retention")
    folder = f"{root}/in"
    drops = _marked_drops(ev, N_DROPS)
    for i, drop in enumerate(drops):
        drop_files(drop, folder)
        counts = jobs.hourly_counts(spark.readStream.schema(drop.schema).parquet(folder), "ts")
        run_available(counts, f"{root}/ckpt", batch_sink(f"{root}/out"), stateful=True,
                      flush_idle=i == len(drops) - 1)
    return read_sink(spark, f"{root}/out", "window_start timestamp_ntz, window_end timestamp_ntz, n long") \
        .select("window_start", "window_end", "n")


# Every tenth event is held back and arrives after all others; the watermark is then an hour
# behind the newest of these, and windows that end before it are closed.
_LATE_SQL = """
WITH t AS (SELECT event_id % 10 = 0 AS held, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end FROM events),
w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events WHERE event_id % 10 <> 0)
SELECT count(*) + 1 AS n_read, count(*) FILTER (WHERE NOT held OR window_end > mark) AS n_kept, 1::BIGINT AS n_open,
       0::BIGINT AS n_untimed, count(*) FILTER (WHERE held AND window_end <= mark) AS n_late
FROM t, w
"""


@query("retention_late", _LATE_SQL)
def q_retention_late(spark, sf_dir):
    """Account of a stream with late rows: all that was read is kept, open or late. The marker
    that closes the last windows is in an open one itself."""
    ev = load(spark, sf_dir, "events")
    root = shared_path(spark, "late")
    folder = f"{root}/in"
    marker = ev.agg(F.max("ts").alias("ts")).select(
        *((F.col("ts") + F.expr("INTERVAL 5 HOURS") if c == "ts" else F.lit(None).cast(ev.schema[c].dataType)).alias(c)
          for c in ev.columns))
    for drop in (ev.filter("event_id % 10 <> 0"), ev.filter("event_id % 10 = 0"), marker):
        drop_files(drop, folder)
        jobs.retention_run(spark.readStream.schema(ev.schema).parquet(folder), "ts", f"{root}/ckpt", f"{root}/out",
                           f"{root}/account")
    return jobs.retention_account(spark, f"{root}/ckpt", f"{root}/out", f"{root}/account")


# -- 23: sessions ----------------------------------------------------------------------

SESSIONS_SQL = f"""
WITH g AS (
  SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL {GAP_SECONDS} SECOND
                           THEN 1 ELSE 0 END AS s
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session_no FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL {GAP_SECONDS} SECOND AS session_end,
       count(*) AS n_events
FROM n GROUP BY user_id, session_no
"""


@query("member_sessions", SESSIONS_SQL)
def q_member_sessions(spark, sf_dir):
    """Sessions per user closed after one hour of silence (batch form; a
    user with a third of all events is still spread over many tasks)."""
    ev = load(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    numbered = gap_sessions(ev, ["user_id"], "ts", GAP_SECONDS, tiebreak=["event_id"])
    g = numbered.groupBy("user_id", "session_no").agg(F.min("ts").alias("session_start"),
                                                      F.max("ts").alias("_last"),
                                                      F.count(F.lit(1)).alias("n_events"))
    return g.select("user_id", "session_start",
                    (F.col("_last") + F.make_dt_interval(secs=F.lit(GAP_SECONDS))).alias("session_end"), "n_events")


@query("member_sessions_stream", SESSIONS_SQL)
def q_member_sessions_stream(spark, sf_dir):
    """Stream form: ``session_window`` with a watermark over time-ordered drops."""
    ev = load(spark, sf_dir, "events")
    root = shared_path(spark, "sessions")
    folder = f"{root}/in"
    drops = _marked_drops(ev, N_DROPS)
    for i, drop in enumerate(drops):
        drop_files(drop, folder)
        s = jobs.member_sessions_stream(spark.readStream.schema(drop.schema).parquet(folder), "user_id", "ts",
                                        extra=["is_marker"])
        run_available(s, f"{root}/ckpt", batch_sink(f"{root}/out"), stateful=True,
                      flush_idle=i == len(drops) - 1, conf=jobs.LOCAL_SESSION_MERGE)
    out = read_sink(spark, f"{root}/out")
    return out.filter(~F.col("is_marker")).select("user_id", "session_start", "session_end", "n_events")


# -- 24: flush policy ------------------------------------------------------------------

@query("flush_policy", f"""
SELECT CAST({_drop_sql(N_DROPS)} AS INTEGER) AS batch_id, count(*) AS n_rows, min(event_id) AS first_event,
       max(event_id) AS last_event
FROM events GROUP BY 1
""")
def q_flush_policy(spark, sf_dir):
    """Four drops, each flushed when it has arrived, in micro-batches of a gigabyte at most: one output
    row per micro-batch, in the order of the drops."""
    ev = load(spark, sf_dir, "events")
    root = shared_path(spark, "flush")
    folder = f"{root}/in"
    stream = spark.readStream.schema(ev.schema).option("maxBytesPerTrigger", 1 << 30)

    def summary(df, batch_id):
        return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min("event_id").alias("first_event"),
                      F.max("event_id").alias("last_event"))
    for drop in _time_drops(ev, "ts", N_DROPS):
        drop_files(drop, folder)
        run_available(stream.parquet(folder), f"{root}/ckpt", batch_sink(f"{root}/out", summary))
    return read_sink(spark, f"{root}/out").select("batch_id", "n_rows", "first_event", "last_event")


@query("flush_count_or_time", f"""
WITH RECURSIVE {TOPIC_SQL},
o AS (SELECT partition, "offset" AS i, timestamp AS ts, event_id FROM topic_o),
within AS (SELECT *, count(*) OVER (PARTITION BY partition) AS n, count(*) OVER (PARTITION BY partition ORDER BY ts
           RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 12 HOUR FOLLOWING) AS upto FROM o),
jump AS (SELECT partition, i, least(i + 25, upto) AS nxt FROM within WHERE least(i + 25, upto) < n),
roll AS (SELECT DISTINCT partition, 0::BIGINT AS i, 0::BIGINT AS flush FROM o
         UNION ALL SELECT r.partition, j.nxt, r.flush + 1 FROM roll r JOIN jump j ON r.partition = j.partition AND r.i = j.i)
SELECT o.partition, max(r.flush) AS flush, o.event_id FROM o JOIN roll r ON o.partition = r.partition AND r.i <= o.i GROUP BY ALL
""")
def q_flush_count_or_time(spark, sf_dir):
    """The records of each shard, streamed in two drops, flushed by 25 messages or 12 hours, whichever
    comes first; a marker three days later lets the last ones go. One state partition per shard."""
    recs = assign_shard(topic_records(spark, sf_dir), "key", N_SHARDS).select("partition", "timestamp", "event_id")
    root = shared_path(spark, "flush-state")
    folder = f"{root}/in"
    marker = recs.agg(F.lit(-1).alias("partition"), (F.max("timestamp") + F.expr("INTERVAL 3 DAYS")).alias("timestamp"),
                      F.lit(None).cast("bigint").alias("event_id"))
    drops = [*_time_drops(recs, "timestamp", 2), marker]
    conf = STATE_CONF | {"spark.sql.shuffle.partitions": str(N_SHARDS)}
    for i, drop in enumerate(drops):
        drop_files(drop, folder)
        flushed = flush_stream(spark.readStream.schema(recs.schema).parquet(folder), "partition", "timestamp", ["event_id"], [],
                               25, 12 * 3_600_000)
        run_available(flushed, f"{root}/ckpt", batch_sink(f"{root}/out"), conf=conf, flush_idle=i == len(drops) - 1)
    return read_sink(spark, f"{root}/out").filter("partition >= 0").select("partition", "flush", "event_id")


# -- 39 (stream form) ----------------------------------------------------------------------

@query("distinct_members_stream", """
SELECT DISTINCT user_id, event_type FROM events
""")
def q_distinct_members_stream(spark, sf_dir):
    """Streaming de-duplication of (user, event type) pairs, each pair once ever."""
    ev = load(spark, sf_dir, "events")
    root = shared_path(spark, "dedupe")
    folder = f"{root}/in"
    for drop in _time_drops(ev, "ts", N_DROPS):
        drop_files(drop, folder)
        d = jobs.distinct_stream(spark.readStream.schema(ev.schema).parquet(folder), ["user_id", "event_type"])
        run_available(d, f"{root}/ckpt", batch_sink(f"{root}/out"), stateful=True)
    return read_sink(spark, f"{root}/out").select("user_id", "event_type")
