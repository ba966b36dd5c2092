"""Stand-in inputs built from the driver tables (see FIXTURES.md, part C).

Every frame here is derived by Spark from the given tables, so its size
grows with them; nothing is synthesised on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardline.functions.scalars import encode_payload
from shardline.operators.topic import assign_offset, assign_shard
from shardline.sources.tables import load

TOPIC = "events"
N_SHARDS = 4


def topic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as producer records: key = user id, value = base64(props);
    ``event_id`` and ``event_type`` ride along for checks."""
    ev = load(spark, sf_dir, "events")
    return ev.select(F.lit(TOPIC).alias("topic"),
                     F.col("user_id").cast("string").alias("key"),
                     encode_payload("props").alias("value"),
                     F.col("ts").alias("timestamp"),
                     "event_id", "event_type")


def topic_frame(spark: SparkSession, sf_dir: str, n_shards: int = N_SHARDS,
                keep: list[str] | None = None) -> DataFrame:
    """The topic over events: shard by key, offsets per shard in (ts, event_id)
    order. ``keep`` narrows the carried columns before the offsets are
    materialised (a checkpoint ends Catalyst's column pruning)."""
    recs = assign_shard(topic_records(spark, sf_dir), "key", n_shards)
    if keep is not None:
        recs = recs.select("partition", *dict.fromkeys(["timestamp", "event_id", *keep]))
    return assign_offset(recs, "partition", ["timestamp", "event_id"])


# SQL of the same frame, for oracles (DuckDB).
TOPIC_SQL = f"""
topic AS (
  SELECT 'events' AS topic, CAST(user_id AS VARCHAR) AS key,
         to_base64(encode(props)) AS value, ts AS timestamp, event_id, event_type,
         CAST((('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8))::BIGINT % {N_SHARDS}) AS INTEGER) AS partition
  FROM events),
topic_o AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY partition ORDER BY timestamp, event_id) - 1 AS BIGINT) AS "offset"
  FROM topic)
"""
