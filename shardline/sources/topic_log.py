"""A topic on files, with the broker row shape, and its readers.

There is no Kafka connector on the class path here (``format("kafka")``
fails), so a topic is a parquet folder with one sub-folder per produced batch,
``<path>/batch=<n>/part-*.parquet``, with columns
``topic, partition, offset, key, value, timestamp``. A batch is one plain write: its
records are numbered per shard after the highest offset of the batches before it, and
overwrite the batch's own folder, so that a batch that was half written or is replayed
comes out the same. Readers are batch (``spark.read``) or stream
(``spark.readStream``) over the folder; a reader group's position is its own
checkpoint folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardline.operators.topic import assign_offset, assign_shard
from shardline.session import exists

TOPIC_COLUMNS = ["topic", "partition", "offset", "key", "value", "timestamp"]
LOG_SCHEMA = ("topic string, partition int, offset bigint, key string, value string, "
              "timestamp timestamp_ntz, batch int")


def _log(spark: SparkSession, path: str) -> DataFrame:
    """All records with their batch; none of a topic that nothing was produced to."""
    if not exists(spark, path):
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def batch_count(spark: SparkSession, path: str) -> int:
    """Batches produced so far: the number after the last one (``batch`` is a folder name, no file is read)."""
    return int(_log(spark, path).agg(F.coalesce(F.max("batch") + 1, F.lit(0))).first()[0])


def end_offsets(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Next offset per shard (``partition, next_offset``), of the batches below ``before``; two
    columns are scanned and combined in the tasks."""
    log = _log(spark, path)
    if before is not None:
        log = log.filter(F.col("batch") < int(before))
    return log.groupBy("partition").agg((F.max("offset") + 1).alias("next_offset"))


def write_topic(df: DataFrame, path: str, topic: str, n_shards: int, key: str = "key", value: str = "value",
                timestamp: str = "timestamp", order: list[str] | None = None, *, batch: int | None = None) -> None:
    """Produce records: shard by key, number them per shard after the current end (in
    ``order``, default the timestamp), write them as one batch: the given one, or the next.
    One producing job at a time per topic; readers may run concurrently."""
    spark = df.sparkSession
    batch = batch_count(spark, path) if batch is None else int(batch)
    order = order or [timestamp]
    recs = df.select(F.lit(topic).alias("topic"), F.col(key).cast("string").alias("key"),
                     F.col(value).cast("string").alias("value"), F.col(timestamp).alias("timestamp"),
                     *[F.col(c) for c in order if c not in (key, value, timestamp)])
    recs = assign_shard(recs, "key", n_shards, fallback="value")
    ends = end_offsets(spark, path, before=batch).select("partition", F.col("next_offset").alias("_sl_next"))
    recs = recs.join(ends, "partition", "left")
    recs = assign_offset(recs, "partition", ["timestamp" if c == timestamp else c for c in order], start_col="_sl_next")
    recs.select(*TOPIC_COLUMNS).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def produce_stream(path: str, topic: str, n_shards: int, order: list[str] | None = None, first_batch: int = 0, **kw):
    """Stream form of :func:`write_topic`, as a ``foreachBatch`` function:
    micro-batch n becomes batch ``first_batch + n`` of the topic, however often
    ``foreachBatch`` replays it."""
    def produce(df: DataFrame, batch_id: int) -> None:
        write_topic(df, path, topic, n_shards, order=order, batch=first_batch + int(batch_id), **kw)
    return produce


@dataclass(frozen=True)
class Positions:
    """Start offsets per shard, fixed when a mapping is made (at most one
    entry per shard: a bounded literal)."""
    starts: tuple[tuple[int, int], ...]

    def filter(self) -> Column:
        """``(shard = p AND offset >= o_p) OR ... OR shard not seen``: data
        columns only, so parquet skips the row groups before the positions
        (for streams ``GroupReader.seek_latest`` skips whole files unread)."""
        if not self.starts:
            return F.lit(True)
        cond = ~F.col("partition").isin([p for p, _ in self.starts]) | F.col("partition").isNull()
        for p, o in self.starts:
            cond = cond | ((F.col("partition") == F.lit(p)) & (F.col("offset") >= F.lit(o)))
        return cond


def latest_positions(spark: SparkSession, path: str) -> Positions:
    """Positions after the last record now in the log ("latest")."""
    rows = end_offsets(spark, path).collect()  # one row per shard
    return Positions(tuple(sorted((int(r["partition"]), int(r["next_offset"])) for r in rows)))


def read_topic(spark: SparkSession, path: str, start: str | Positions = "earliest", *, stream: bool = False,
               max_files_per_trigger: int | None = None) -> DataFrame:
    """Records of the log from the first record (``earliest``) or from
    positions taken earlier (``latest_positions``: only records that arrive
    after the mapping was made). ``stream=True`` gives a streaming frame."""
    if start == "latest":
        start = latest_positions(spark, path)
    if stream:
        reader = spark.readStream.schema(LOG_SCHEMA)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
        df = reader.parquet(path)
    else:
        df = spark.read.schema(LOG_SCHEMA).parquet(path)
    if isinstance(start, Positions):
        df = df.filter(start.filter())
    return df.select(*TOPIC_COLUMNS)


def kafka_options(bootstrap_servers: str, topic: str, group: str | None = None, start: str = "earliest",
                  max_offsets_per_trigger: int | None = None) -> dict[str, str]:
    """Options for Spark's Kafka source with the same meaning as above."""
    opts = {"kafka.bootstrap.servers": bootstrap_servers, "subscribe": topic, "startingOffsets": start}
    if group:
        opts["kafka.group.id"] = group
    if max_offsets_per_trigger:
        opts["maxOffsetsPerTrigger"] = str(int(max_offsets_per_trigger))
    return opts
