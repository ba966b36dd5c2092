"""Topic-log operators: shards, offsets, size limit, segments, retention, description.

A topic record has the broker row shape
``topic STRING, partition INT, offset BIGINT, key, value, timestamp``;
``partition`` is the shard. Every rule is a column expression or a
partial aggregation; per-shard order uses the distributed scans of
:mod:`shardline.operators.ordered`, so one hot shard is still spread over
many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardline.functions.scalars import epoch_micros
from shardline.operators.ordered import dense_index, prefix_sum
from shardline.operators.roll import greedy_roll

# Fixed values of the broker configuration these rules come from.
MESSAGE_MAX_BYTES = 3086624          # message.max.bytes
LOG_RETENTION_HOURS = 1              # log.retention.hours
LOG_SEGMENT_BYTES = 1073741824       # log.segment.bytes
LOG_RETENTION_BYTES = 1073741824     # log.retention.bytes (commented default)
FLUSH_MESSAGES = 10000               # log.flush.interval.messages (commented default)
FLUSH_MILLIS = 1000                  # log.flush.interval.ms (commented default)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def shard_of(key, n: int, fallback=None) -> Column:
    """Shard id in [0, n) of a key: the first 32 bits of md5(key), modulo n.
    The same key always lands on the same shard. Null keys are spread by the
    ``fallback`` column (for example the payload) instead of piling onto one
    shard; without a fallback they go to shard 0."""
    def h(c: Column) -> Column:
        return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint")
    k = _c(key)
    hashed = h(k)
    if fallback is not None:
        hashed = F.coalesce(hashed, h(_c(fallback)))
    return F.coalesce(F.pmod(hashed, F.lit(int(n))), F.lit(0)).cast("int")


def assign_shard(df: DataFrame, key, n: int, out: str = "partition", *, place: bool = False,
                 fallback=None) -> DataFrame:
    """Add the shard column; ``place=True`` also moves rows so that Spark partition
    i holds shard i and nothing else, as a broker does. See ``placement_profile`` for
    what that does to a skewed shard."""
    res = df.withColumn(out, shard_of(key, n, fallback))
    return res.repartitionById(int(n), F.col(out)) if place else res


def assign_offset(df: DataFrame, shard: str = "partition", order=("timestamp",), out: str = "offset", *,
                  start_col: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Per-shard increasing offsets 0, 1, 2, ... in ``order``; ``start_col``
    (if given) is added, so appends continue an existing log."""
    res = dense_index(df, [shard], list(order), out, num_partitions=num_partitions)
    if start_col:
        res = res.withColumn(out, F.col(out) + F.coalesce(F.col(start_col), F.lit(0))).drop(start_col)
    return res


def flag_size(df: DataFrame, value, max_bytes: int = MESSAGE_MAX_BYTES,
              bytes_out: str = "n_bytes", flag_out: str = "accepted") -> DataFrame:
    """Add the record size in bytes and whether it fits the limit."""
    return (df.withColumn(bytes_out, F.octet_length(_c(value)).cast("bigint"))
              .withColumn(flag_out, F.col(bytes_out) <= F.lit(int(max_bytes))))


def size_limit(df: DataFrame, value, max_bytes: int = MESSAGE_MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Split records into (accepted, rejected); every record lands in exactly
    one output (a null value has no size and is rejected)."""
    flagged = flag_size(df, value, max_bytes)
    ok = F.coalesce(F.col("accepted"), F.lit(False))
    return flagged.filter(ok), flagged.filter(~ok)


def assign_segment(df: DataFrame, shard, order, size_col: str, seg_bytes: int = LOG_SEGMENT_BYTES,
                   out: str = "segment", *, num_partitions: int | None = None) -> DataFrame:
    """Fixed-width byte segments per shard: a record belongs to segment
    ``floor(bytes of earlier records of its shard / seg_bytes)``."""
    prev = "_sl_prev_bytes"
    res = prefix_sum(df, [shard] if isinstance(shard, str) else list(shard), order, size_col, prev,
                     num_partitions=num_partitions)
    return res.withColumn(out, F.expr(f"`{prev}` div {int(seg_bytes)}")).drop(prev)


def roll_segments(df: DataFrame, shard: str, order, size_col: str, seg_bytes: int = LOG_SEGMENT_BYTES,
                  out: str = "segment", *, num_partitions: int | None = None) -> DataFrame:
    """Segments as a log rolls them: a record that would bring the open segment of its shard
    over ``seg_bytes`` begins the next one (a larger record has one of its own)."""
    return greedy_roll(df, shard, order, size=size_col, max_bytes=seg_bytes, out=out, num_partitions=num_partitions)


def flush_batches(df: DataFrame, shard: str, order, ts: str, messages: int = FLUSH_MESSAGES, millis: int = FLUSH_MILLIS,
                  out: str = "flush", *, num_partitions: int | None = None) -> DataFrame:
    """Number the flushes of each shard: after ``messages`` records, or with the first record that is
    more than ``millis`` later than the first one not flushed yet, whichever comes first."""
    return greedy_roll(df, shard, order, max_count=messages, time_us=epoch_micros(ts), max_micros=1000 * millis, out=out,
                       num_partitions=num_partitions)


def retain_by_time(df: DataFrame, ts: str, hours: int = LOG_RETENTION_HOURS) -> DataFrame:
    """Keep records no older than ``hours`` before the newest record.

    "Now" is the newest record (reruns agree, no wall clock); the maximum is a
    scalar subquery: computed once with a partial aggregation, no cross join."""
    newest = df.agg(F.max(ts)).scalar()
    return df.filter(F.col(ts) >= newest - F.make_dt_interval(hours=F.lit(int(hours))))


def retain_segments_by_time(df: DataFrame, shard: str, segment: str, ts: str,
                            hours: int = LOG_RETENTION_HOURS) -> DataFrame:
    """Drop whole segments whose newest record is older than the horizon."""
    segs = df.groupBy(shard, segment).agg(F.max(ts).alias("_sl_seg_max"))
    newest = df.agg(F.max(ts)).scalar()  # same value, from the ts column alone
    keep = segs.filter(F.col("_sl_seg_max") >= newest - F.make_dt_interval(hours=F.lit(int(hours))))
    return df.join(keep.select(shard, segment), [shard, segment], "left_semi")


def retain_by_size(df: DataFrame, shard: str, segment: str, size_col: str,
                   limit_bytes: int = LOG_RETENTION_BYTES) -> DataFrame:
    """Delete the oldest segments of a shard while the rest stays at least
    ``limit_bytes``: a segment survives iff the bytes of strictly newer
    segments are below the limit (the newest segment always survives)."""
    segs = df.groupBy(shard, segment).agg(F.sum(size_col).cast("bigint").alias("_sl_seg_bytes"))
    newer = prefix_sum(segs, [shard], [F.col(segment).desc()], "_sl_seg_bytes", "_sl_newer")
    keep = newer.filter(F.col("_sl_newer") < F.lit(int(limit_bytes))).select(shard, segment)
    return df.join(keep, [shard, segment], "left_semi")


def describe_topic(df: DataFrame, shard: str = "partition") -> DataFrame:
    """Per shard: records, first/last offset, first/last time, payload bytes."""
    return (df.groupBy(shard)
              .agg(F.count(F.lit(1)).alias("n_records"),
                   F.min("offset").alias("first_offset"),
                   F.max("offset").alias("last_offset"),
                   F.min("timestamp").alias("first_ts"),
                   F.max("timestamp").alias("last_ts"),
                   F.sum(F.octet_length("value")).cast("bigint").alias("n_bytes")))
