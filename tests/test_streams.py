"""Stream behaviour: late rows dropped by the watermark, handler swap loses
nothing, reader groups resume, latest start, stream = batch."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from shardline.session import hadoop_path, shared_path
from shardline.sources.topic_log import batch_count, latest_positions, produce_stream, read_topic, write_topic
from shardline.streaming import jobs
from shardline.streaming.runs import batch_sink, drop_files, read_sink, run_available

SCHEMA = "event_id long, ts timestamp_ntz, user_id long"
T0 = dt.datetime(2024, 1, 1)


def _ev(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_late_row_is_dropped(spark):
    root = shared_path(spark, "t-late")
    folder = f"{root}/in"
    drops = [
        [(1, T0 + dt.timedelta(minutes=10), 1), (2, T0 + dt.timedelta(hours=3), 1)],
        [(3, T0 + dt.timedelta(minutes=20), 1)],           # 2h40 behind the newest: late
        [(4, T0 + dt.timedelta(hours=10), 1)],             # closes the earlier windows
    ]
    for d in drops:
        drop_files(_ev(spark, d), folder)
        s = jobs.hourly_counts(spark.readStream.schema(SCHEMA).parquet(folder), "ts")
        run_available(s, f"{root}/ckpt", batch_sink(f"{root}/out"))
    got = {(r.window_start.hour, r.n) for r in read_sink(spark, f"{root}/out").collect()}
    assert got == {(0, 1), (3, 1)}


def test_swap_handler_loses_nothing(spark):
    root = shared_path(spark, "t-swap")
    folder = f"{root}/in"
    drop_files(_ev(spark, [(i, T0 + dt.timedelta(seconds=i), 1) for i in range(100)]), folder)
    m = jobs.FunctionMapping(lambda: spark.readStream.schema(SCHEMA).parquet(folder), f"{root}/ckpt", f"{root}/out")
    m.start(lambda df: df.select("event_id"), 1)
    drop_files(_ev(spark, [(i, T0 + dt.timedelta(seconds=i), 1) for i in range(100, 150)]), folder)
    m.swap(lambda df: df.select("event_id"), 2)
    out = read_sink(spark, f"{root}/out")
    by_version = {r.handler_version: r.n for r in out.groupBy("handler_version").agg(F.count("*").alias("n")).collect()}
    assert by_version == {1: 100, 2: 50}
    assert out.select("event_id").distinct().count() == 150
    assert sorted(r.batch_id for r in out.select("batch_id").distinct().collect()) == [0, 1]


def test_swap_is_guarded_by_a_revision(spark):
    """Of two processes that know the same revision one swaps, the other is refused and changes
    nothing; a restarted one knows revision and version."""
    root = shared_path(spark, "t-revision")
    folder = f"{root}/in"
    make = lambda: jobs.FunctionMapping(lambda: spark.readStream.schema(SCHEMA).parquet(folder),
                                        f"{root}/ckpt", f"{root}/out")
    add = lambda lo, hi: drop_files(_ev(spark, [(i, T0, 1) for i in range(lo, hi)]), folder)
    plain = lambda df: df.select("event_id")
    add(0, 10)
    a = make()
    assert a.current() == (0, None)
    a.start(plain, 1)
    b = make()
    assert (b.revision, b.version) == (1, 1)
    add(10, 15)
    a.swap(plain, 2)
    add(15, 18)
    for stale in (lambda: b.swap(plain, 3), lambda: a.swap(plain, 3, revision=1), lambda: a.swap(plain, 2), lambda: b.start(plain, 1)):
        with pytest.raises(jobs.StaleRevision):
            stale()
    assert read_sink(spark, f"{root}/out").count() == 15 and make().current() == (2, 2)
    restarted = make().start(plain, 2)
    add(18, 20)
    restarted.swap(plain, 7, revision=2)
    assert make().current() == (3, 7)
    got = {(r.handler_version, r.event_id) for r in read_sink(spark, f"{root}/out").collect()}
    assert got == {(1, i) for i in range(10)} | {(2, i) for i in range(10, 18)} | {(7, i) for i in (18, 19)}


def test_late_rows_are_accounted_for(spark):
    """At every moment what was read is kept, open, without a time, or late."""
    root = shared_path(spark, "t-account")
    folder = f"{root}/in"
    at = lambda h, m=0: T0 + dt.timedelta(hours=h, minutes=m)
    drops = [([(1, at(0, 10), 1), (2, at(3), 1), (3, None, 1)], (3, 0, 2, 1, 0)),
             ([(4, at(0, 20), 1), (5, at(0, 30), 2), (6, at(3, 1), 1)], (6, 1, 2, 1, 2)),
             ([(7, at(10), 1)], (7, 3, 1, 1, 2)), ([(8, at(2), 1), (9, None, 1)], (9, 3, 1, 2, 3))]
    for rows, want in drops:
        drop_files(_ev(spark, rows), folder)
        jobs.retention_run(spark.readStream.schema(SCHEMA).parquet(folder), "ts", f"{root}/ckpt", f"{root}/out", f"{root}/account")
        r = jobs.retention_account(spark, f"{root}/ckpt", f"{root}/out", f"{root}/account").first()
        assert (r.n_read, r.n_kept, r.n_open, r.n_untimed, r.n_late) == want or rows == drops[0][0], (rows, r)
        assert r.n_read == r.n_kept + r.n_open + r.n_untimed + r.n_late


def _records(spark, lo, hi):
    return spark.createDataFrame([(str(i % 5), f"v{i}", T0 + dt.timedelta(seconds=i), i) for i in range(lo, hi)],
                                 "key string, value string, timestamp timestamp_ntz, id long")


def test_groups_resume_and_latest(spark):
    path = shared_path(spark, "t-topic")
    root = shared_path(spark, "t-groups")
    a = jobs.GroupReader(spark, path, "a", f"{root}/ckpt", f"{root}/out")
    write_topic(_records(spark, 0, 30), path, "t", 3, order=["timestamp", "id"])
    a.poll()
    pos = latest_positions(spark, path)
    late = jobs.GroupReader(spark, path, "late", f"{root}/ckpt", f"{root}/late-out")
    late.seek_latest()
    write_topic(_records(spark, 30, 50), path, "t", 3, order=["timestamp", "id"])
    a.poll()
    late.poll()
    b = jobs.GroupReader(spark, path, "b", f"{root}/ckpt", f"{root}/out")
    b.poll()
    out = spark.read.parquet(f"{root}/out")
    runs = {(r.group_id, r.batch_id): r.n for r in out.groupBy("group_id", "batch_id").agg(F.count("*").alias("n")).collect()}
    assert runs == {("a", 0): 30, ("a", 1): 20, ("b", 0): 50}
    # offsets are dense per shard across both appends
    log = read_topic(spark, path)
    per = log.groupBy("partition").agg(F.count("*").alias("n"), F.max("offset").alias("m")).collect()
    assert all(r.m == r.n - 1 for r in per)
    by_positions = read_topic(spark, path, pos)
    streamed = spark.read.parquet(f"{root}/late-out").select(*by_positions.columns)
    assert by_positions.count() == 20
    assert streamed.exceptAll(by_positions).count() == 0 and by_positions.exceptAll(streamed).count() == 0


def test_sessions_stream_equals_batch(spark):
    from shardline.operators.ordered import gap_sessions
    rows = [(i, T0 + dt.timedelta(minutes=m), u) for i, (m, u) in
            enumerate([(0, 1), (30, 1), (90, 1), (151, 1), (0, 2), (60, 2), (400, 3)])]
    root = shared_path(spark, "t-sess")
    folder = f"{root}/in"
    drop_files(_ev(spark, rows), folder)
    drop_files(_ev(spark, [(-1, T0 + dt.timedelta(hours=20), -1)]), folder)
    s = jobs.member_sessions_stream(spark.readStream.schema(SCHEMA).parquet(folder), "user_id", "ts")
    run_available(s, f"{root}/ckpt", batch_sink(f"{root}/out"))
    stream = {(r.user_id, r.session_start, r.n_events) for r in read_sink(spark, f"{root}/out").collect()
              if r.user_id >= 0}
    b = gap_sessions(_ev(spark, rows), ["user_id"], "ts", 3600, tiebreak=["event_id"])
    batch = {(r.user_id, r.s, r.n) for r in
             b.groupBy("user_id", "session_no").agg(F.min("ts").alias("s"), F.count("*").alias("n")).collect()}
    assert stream == batch
    assert len(batch) == 4   # user 1: 0-90 (30-min steps), 151; user 2: 0-60 (exactly one gap); user 3


def test_kafka_options():
    from shardline.sources.topic_log import kafka_options
    assert kafka_options("b:9092", "t", "g", "latest", 1000) == {
        "kafka.bootstrap.servers": "b:9092", "subscribe": "t", "startingOffsets": "latest",
        "kafka.group.id": "g", "maxOffsetsPerTrigger": "1000"}


def test_processing_time_trigger_flushes(spark):
    root = shared_path(spark, "t-trigger")
    folder = f"{root}/in"
    drop_files(_ev(spark, [(i, T0 + dt.timedelta(seconds=i), 1) for i in range(20)]), folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    w = stream.writeStream.option("checkpointLocation", f"{root}/ckpt").foreachBatch(batch_sink(f"{root}/out"))
    q = jobs.flush_every(w, "1 second").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert read_sink(spark, f"{root}/out").count() == 20


def _remove(spark, path):
    p, fs = hadoop_path(spark, path)
    assert fs.delete(p, True)


def _dense(log, n):
    per = log.groupBy("partition").agg(F.count("*").alias("n"), F.max("offset").alias("m"),
                                       F.count_distinct("offset").alias("d")).collect()
    return sum(r.n for r in per) == n and all(r.m == r.n - 1 == r.d - 1 for r in per)


def test_produced_batches_are_replayed_whole(spark):
    """A batch that is replayed, whole or half written, comes out the same."""
    path = shared_path(spark, "t-produce")
    produce = produce_stream(path, "t", 3, order=["timestamp", "id"])
    batch = _records(spark, 0, 1000).repartition(4)
    produce(batch, 0)
    produce(batch, 0)
    produce(_records(spark, 1000, 1015), 1)
    assert _dense(read_topic(spark, path), 1015)
    # the crash: some files of the last batch are gone
    p, fs = hadoop_path(spark, f"{path}/batch=1")
    parts = [x.getPath().toString() for x in fs.listStatus(p) if "part-" in x.getPath().getName()]
    _remove(spark, parts[0])
    produce(_records(spark, 1000, 1015), 1)
    assert _dense(read_topic(spark, path), 1015)
    write_topic(_records(spark, 1015, 1020), path, "t", 3, order=["timestamp", "id"])
    assert _dense(read_topic(spark, path), 1020) and batch_count(spark, path) == 3


def test_replayed_group_batch_is_not_repeated(spark):
    """The commit of a batch is lost after its output was written; a new reader object
    (a restarted process) reads it again and overwrites it."""
    path, root = shared_path(spark, "t-topic"), shared_path(spark, "t-replay")
    write_topic(_records(spark, 0, 300), path, "t", 3, order=["timestamp", "id"])
    make = lambda: jobs.GroupReader(spark, path, "a", f"{root}/ckpt", f"{root}/out")
    make().poll()
    _remove(spark, f"{root}/ckpt/a/commits/0")
    make().poll()
    out = spark.read.parquet(f"{root}/out")
    assert out.count() == 300 and out.select("partition", "offset").distinct().count() == 300


def _size_handler(events):
    return events.select("partition", "batch", "n_records", "first_offset", "last_offset",
                         F.transform("Records", lambda r: r["kinesis"]["data"]).alias("data"))


def test_whole_batches_with_a_lagging_shard(spark):
    """One file per micro-batch, a shard far behind the others in time, two produce
    rounds, a lost commit: every record is delivered once, every batch whole."""
    path, root = shared_path(spark, "t-lag"), shared_path(spark, "t-lag-run")
    slow = [(str(i % 5), f"s{i}", T0 - dt.timedelta(days=50), i) for i in range(103)]
    schema = "key string, value string, timestamp timestamp_ntz, id long"
    write_topic(_records(spark, 0, 400).repartition(3), path, "t", 4, order=["timestamp", "id"])
    run = lambda: jobs.handle_batches_stream(
        read_topic(spark, path, stream=True, max_files_per_trigger=1), f"{root}/ckpt", f"{root}/out", 10, _size_handler)
    run()
    write_topic(spark.createDataFrame(slow, schema).repartition(3), path, "t", 4, order=["timestamp", "id"])
    last = run()
    p, fs = hadoop_path(spark, f"{root}/ckpt/commits")
    newest = max(int(x.getPath().getName()) for x in fs.listStatus(p) if x.getPath().getName().isdigit())
    _remove(spark, f"{root}/ckpt/commits/{newest}")
    run()
    last.close(spark)
    log = read_topic(spark, path)
    out = read_sink(spark, f"{root}/out")
    assert out.agg(F.sum("n_records")).first()[0] == log.count() == 503
    want = {(r.partition, r.b): r.n for r in log.groupBy("partition", F.expr("offset div 10").alias("b"))
            .agg(F.count("*").alias("n")).collect()}
    assert {(r.partition, r.batch): r.n_records for r in out.collect()} == want and out.count() == len(want)
    assert out.select(F.explode("data").alias("value")).exceptAll(log.select("value")).count() == 0


def test_batch_window(spark):
    """An incomplete batch waits until its window has passed, and only then goes."""
    path, root = shared_path(spark, "t-win"), shared_path(spark, "t-win-run")
    write_topic(_records(spark, 0, 7), path, "t", 1, order=["timestamp", "id"])
    d = jobs.handle_batches_stream(read_topic(spark, path, stream=True), f"{root}/ckpt", f"{root}/out", 5,
                                   _size_handler, window_seconds=600)
    sizes = lambda: sorted((r.batch, r.n_records) for r in read_sink(spark, f"{root}/out").collect())
    d.close(spark)
    assert sizes() == [(0, 5)]
    write_topic(_records(spark, 7, 11), path, "t", 1, order=["timestamp", "id"])
    d = jobs.handle_batches_stream(read_topic(spark, path, stream=True), f"{root}/ckpt", f"{root}/out", 5,
                                   _size_handler, window_seconds=600)
    d.close(spark)
    assert sizes() == [(0, 5), (1, 5)]
    d.close(spark, dt.datetime.now(dt.timezone.utc) + dt.timedelta(seconds=601))
    d.close(spark, dt.datetime.now(dt.timezone.utc) + dt.timedelta(seconds=601))
    assert sizes() == [(0, 5), (1, 5), (2, 1)]


def test_drops_keep_rows_without_a_time(spark):
    from shardline.plans.q_streams import _time_drops
    rows = [(i, None if i % 9 == 0 else T0 + dt.timedelta(minutes=i), 1) for i in range(100)]
    drops = _time_drops(_ev(spark, rows), "ts", 4)
    assert sum(d.count() for d in drops) == 100 and all(d.count() > 10 for d in drops)
    assert sum(d.count() for d in _time_drops(_ev(spark, [(1, None, 1)]), "ts", 4)) == 1


def test_distinct_stream_has_no_horizon(spark):
    """The same pair 64 days apart appears once."""
    root = shared_path(spark, "t-dist")
    for day in (0, 40, 64):
        drop_files(_ev(spark, [(day, T0 + dt.timedelta(days=day), u) for u in (1, None)]), f"{root}/in")
        s = jobs.distinct_stream(spark.readStream.schema(SCHEMA).parquet(f"{root}/in"), ["user_id"])
        run_available(s, f"{root}/ckpt", batch_sink(f"{root}/out"), stateful=True)
    assert sorted((r.user_id for r in read_sink(spark, f"{root}/out").collect()), key=str) == [1, None]


def test_unreadable_sinks_are_not_empty(spark):
    schema = "x long"
    assert read_sink(spark, shared_path(spark, "t-none"), schema).count() == 0
    path = shared_path(spark, "t-bad")
    spark.createDataFrame([("no parquet",)], "value string").write.text(f"{path}/batch_id=0")
    with pytest.raises(Exception):
        read_sink(spark, path, schema).collect()


def test_event_time_ignores_the_session_zone(spark):
    """Hourly windows and sessions come out the same under a half-hour-offset
    session zone, without pinning UTC."""
    key = "spark.sql.session.timeZone"
    spark.conf.set(key, "Asia/Kolkata")
    try:
        root = shared_path(spark, "t-zone")
        folder = f"{root}/in"
        drop_files(_ev(spark, [(1, T0 + dt.timedelta(minutes=10), 1), (2, T0 + dt.timedelta(minutes=50), 1),
                               (3, T0 + dt.timedelta(hours=5), 1)]), folder)
        s = jobs.hourly_counts(spark.readStream.schema(SCHEMA).parquet(folder), "ts")
        run_available(s, f"{root}/ckpt", batch_sink(f"{root}/out"), stateful=True)
        got = {(r.window_start, r.window_end, r.n) for r in read_sink(spark, f"{root}/out").collect()}
    finally:
        spark.conf.set(key, "UTC")
    assert got == {(T0, T0 + dt.timedelta(hours=1), 2)}


def test_hourly_counts_stream_equals_batch(spark):
    from pyspark.sql import functions as F
    from shardline.streaming.runs import to_event_time, to_wall_clock
    rows = [(i, T0 + dt.timedelta(minutes=7 * i), i % 3) for i in range(60)]
    root = shared_path(spark, "t-hourly")
    folder = f"{root}/in"
    drop_files(_ev(spark, rows[:30]), folder)
    for part in (rows[30:], [(-1, T0 + dt.timedelta(hours=20), -1)]):
        s = jobs.hourly_counts(spark.readStream.schema(SCHEMA).parquet(folder), "ts")
        run_available(s, f"{root}/ckpt", batch_sink(f"{root}/out"), stateful=True)
        drop_files(_ev(spark, part), folder)
    s = jobs.hourly_counts(spark.readStream.schema(SCHEMA).parquet(folder), "ts")
    run_available(s, f"{root}/ckpt", batch_sink(f"{root}/out"), stateful=True)
    stream = {(r.window_start, r.n) for r in read_sink(spark, f"{root}/out").collect()}
    static = to_event_time(_ev(spark, rows), "ts").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"))
    batch = {(r.s, r.n) for r in static.select(to_wall_clock("window.start").alias("s"), "n").collect()}
    assert stream == batch and sum(n for _, n in batch) == 60


def test_flush_by_count_or_time(spark):
    """Both rules fire, records of one drop come in any order, a drop cuts a flush, and a replayed
    micro-batch emits the same."""
    from shardline.streaming.flush import STATE_CONF, flush_stream
    root = shared_path(spark, "t-flush")
    folder = f"{root}/in"
    minutes = [0, 1, 2, 3, 4, 5, 9, 30, 31, 32, 33, 34, 35, 36, 50, 62, 63, 64]
    rows = [(i, T0 + dt.timedelta(minutes=m), i % 2) for i, m in enumerate(sorted(minutes * 2))]
    drops = [rows[20:3:-1], rows[:4], rows[21:], [(99, T0 + dt.timedelta(hours=9), 7)]]

    def run():
        s = flush_stream(spark.readStream.schema(SCHEMA).parquet(folder), "user_id", "ts", ["event_id"], [], 4, 10 * 60_000)
        run_available(s, f"{root}/ckpt", batch_sink(f"{root}/out"), stateful=True, conf=STATE_CONF)

    for d in drops:
        drop_files(_ev(spark, d).repartition(2), folder)
        run()
    p, fs = hadoop_path(spark, f"{root}/ckpt/commits")
    newest = max(int(x.getPath().getName()) for x in fs.listStatus(p) if x.getPath().getName().isdigit())
    _remove(spark, f"{root}/ckpt/commits/{newest}")
    run()
    want = set()
    for user in (0, 1):
        number, flush = 0, []
        for i, t, _ in (r for r in rows if r[2] == user):
            if flush and (t - flush[0]).total_seconds() > 600:
                number, flush = number + 1, []
            flush.append(t)
            want.add((user, number, i))
            if len(flush) == 4:
                number, flush = number + 1, []
    got = [(r.user_id, r.flush, r.event_id) for r in read_sink(spark, f"{root}/out").collect() if r.user_id < 7]
    assert len(got) == len(want) and set(got) == want


def test_flush_state_holds_blocks(monkeypatch):
    """A state entry is a batch of records, not a record, before and after a timer."""
    import pandas as pd

    from shardline.streaming import flush

    class State(list):
        def exists(self): return bool(self)
        def get(self): return iter(list(self))
        def put(self, entries): self[:] = entries
        def appendValue(self, entry): self.append(entry)
        clear = list.clear

    class Number:
        value = None
        def exists(self): return self.value is not None
        def get(self): return self.value
        def update(self, value): self.value = value

    class Handle:
        waiting, called = State(), []
        def getListState(self, *_): return self.waiting
        def getValueState(self, *_): return Number()
        def registerTimer(self, at): self.called.append(at)

    class Mark:
        def getCurrentWatermarkInMs(self): return 5_000

    p, handle = flush.CountOrTime(["key"], ["us", "c0"], ["c0"], 4, 1000), Handle()
    p.init(handle)
    frames = [pd.DataFrame({"key": 1, "us": range(lo, lo + 10_000_000, 1000), "c0": range(10_000)})
              for lo in (0, 10_000_000)]
    assert list(p.handleInputRows((1,), iter(frames), None)) == [] and len(handle.waiting) == 2
    out = pd.concat(p.handleExpiredTimer((1,), Mark(), None))
    assert out["us"].tolist() == list(range(0, 5_000_000, 1000)) and out["flush"].tolist() == [i // 4 for i in range(5000)]
    assert len(handle.waiting) == 2 and handle.called == [0, 6001, 5001]


def test_flush_carries_values_exactly(spark):
    """Whole numbers beyond a double's beside nulls, NaN beside null, far times, null keys and strings."""
    from shardline.streaming.flush import STATE_CONF, flush_stream
    root = shared_path(spark, "t-flush-types")
    folder = f"{root}/in"
    schema = "k string, ts timestamp_ntz, id bigint, x double, far timestamp_ntz, s string, b boolean, small smallint"
    big, far = 2 ** 60 + 1, dt.datetime(9000, 1, 1, 0, 0, 0, 1)
    rows = [("a", T0, big, float("nan"), far, "x", True, 7), ("a", T0, None, None, None, None, None, None),
            (None, T0, big + 2, 0.5, far, "y", False, None), (None, T0 + dt.timedelta(minutes=1), None, 1.5, None, "", None, 1)]
    for drop in (rows, [("z", T0 + dt.timedelta(days=1), 0, 0.0, None, None, None, 0)]):
        drop_files(spark.createDataFrame(drop, schema).coalesce(1), folder)
        s = flush_stream(spark.readStream.schema(schema).parquet(folder), "k", "ts", ["id"],
                         ["x", "far", "s", "b", "small"], 2, 600_000)
        run_available(s, f"{root}/ckpt", batch_sink(f"{root}/out"), stateful=True, conf=STATE_CONF)
    got = {str((r.k, r.flush, r.id, r.x, r.far, r.s, r.b, r.small)) for r in read_sink(spark, f"{root}/out").collect()}
    assert got == {str((k, 0, *r)) for k, _, *r in rows}
