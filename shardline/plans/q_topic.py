"""Queries for the topic log: flagship, shards, offsets, batches, decode,
size limit, segments, retention, description."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from shardline.functions.scalars import decode_payload, encode_payload
from shardline.operators import topic as tp
from shardline.plans.catalog import query
from shardline.plans.fixtures import N_SHARDS, TOPIC_SQL, topic_frame, topic_records
from shardline.sources.tables import load
from shardline.streaming.handlers import apply_native, batch_events, handle_batches, with_batch

FLAGSHIP_BATCH = 10


@query("shard_batch_summary", f"""
WITH {TOPIC_SQL}
SELECT partition, t.event_type AS event_type,
       count(*) AS n_records,
       count(DISTINCT "offset" // {FLAGSHIP_BATCH}) AS n_batches,
       CAST(sum(octet_length(encode(e.props))) AS BIGINT) AS payload_bytes
FROM topic_o t JOIN events e USING (event_id)
GROUP BY partition, t.event_type
""")
def shard_batch_summary(spark, sf_dir):
    """Flagship: events -> shard -> offset -> batches of 10 -> decode ->
    per shard and event type: records, batches touched, payload bytes."""
    t = topic_frame(spark, sf_dir, keep=["value", "event_type"])
    b = with_batch(t, FLAGSHIP_BATCH)
    return (b.groupBy("partition", "event_type")
             .agg(F.count(F.lit(1)).alias("n_records"),
                  F.count_distinct("batch").alias("n_batches"),
                  F.sum(F.octet_length(decode_payload("value"))).cast("bigint").alias("payload_bytes")))


@query("assign_shard", f"""
WITH {TOPIC_SQL}
SELECT event_id, key, partition FROM topic
""")
def q_assign_shard(spark, sf_dir):
    recs = topic_records(spark, sf_dir).select("event_id", "key")
    return tp.assign_shard(recs, "key", N_SHARDS)


@query("assign_offset", f"""
WITH {TOPIC_SQL}
SELECT event_id, partition, "offset" FROM topic_o
""")
def q_assign_offset(spark, sf_dir):
    return topic_frame(spark, sf_dir, keep=[]).select("event_id", "partition", "offset")


def _batch_sql(size: int) -> str:
    return f"""
WITH {TOPIC_SQL}
SELECT partition, "offset" // {size} AS batch, count(*) AS n_records,
       min("offset") AS first_offset, max("offset") AS last_offset,
       CAST(sum(octet_length(encode(e.props))) AS BIGINT) AS payload_bytes
FROM topic_o t JOIN events e USING (event_id)
GROUP BY partition, "offset" // {size}
"""


@query("handle_batches_1", _batch_sql(1))
def q_handle_batches_1(spark, sf_dir):
    """Batch size 1 (the default) with the native handler: decode each
    record of the event and sum the payload bytes."""
    ev = batch_events(topic_frame(spark, sf_dir, keep=["value"]), batch_size=1)

    def handler(records):
        sizes = F.transform(records, lambda r: F.octet_length(decode_payload(r["kinesis"]["data"])))
        return {"payload_bytes": F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x)}
    return apply_native(ev, handler).select("partition", "batch", "n_records", "first_offset",
                                            "last_offset", "payload_bytes")


def _python_batch_handler(batch: pd.DataFrame) -> dict:
    """A user handler: decode every record of the batch, report its size."""
    import base64
    offsets = batch["offset"].to_numpy()
    sizes = [len(base64.b64decode(v)) for v in batch["value"].to_numpy()]
    return {"n_records": len(offsets), "first_offset": int(offsets[0]), "last_offset": int(offsets[-1]),
            "payload_bytes": int(sum(sizes))}


@query("handle_batches_10", _batch_sql(10))
def q_handle_batches_10(spark, sf_dir):
    """Batch size 10 with a Python handler called once per batch."""
    t = topic_frame(spark, sf_dir, keep=["value"]).select("partition", "offset", "value")
    return handle_batches(t, _python_batch_handler,
                          "n_records long, first_offset long, last_offset long, payload_bytes long",
                          batch_size=10)


@query("decode_payload", """
SELECT conv_id, turn, text AS decoded, octet_length(encode(text)) AS n_bytes,
       length(to_base64(encode(text))) AS encoded_chars
FROM conversations
""")
def q_decode_payload(spark, sf_dir):
    """Encode conversation text as a producer would, decode it as the
    handler does; the decoded text must equal the original."""
    c = load(spark, sf_dir, "conversations")
    enc = c.select("conv_id", "turn", encode_payload("text").alias("data"))
    return enc.select("conv_id", "turn", decode_payload("data").alias("decoded"),
                      F.octet_length(decode_payload("data")).cast("bigint").alias("n_bytes"),
                      # Spark's base64 breaks lines every 76 characters; count payload characters only
                      F.length(F.regexp_replace("data", "[\\r\\n]", "")).cast("bigint").alias("encoded_chars"))


SIZE_LIMIT = 10000  # message.max.bytes scaled to the document sizes


@query("size_limit", f"""
SELECT doc_id, source, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes,
       octet_length(encode(text)) <= {SIZE_LIMIT} AS accepted
FROM documents
""")
def q_size_limit(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return tp.flag_size(d, "text", SIZE_LIMIT).select("doc_id", "source", "n_bytes", "accepted")


@query("size_limit_split", f"""
SELECT doc_id, octet_length(encode(text)) <= {SIZE_LIMIT} AS delivered, source FROM documents
""")
def q_size_limit_split(spark, sf_dir):
    """The two outputs of the size limit, put together again: every record lands in
    exactly one of them."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    good, bad = tp.size_limit(d, "text", SIZE_LIMIT)
    return (good.select("doc_id", F.lit(True).alias("delivered"), "source")
            .unionByName(bad.select("doc_id", F.lit(False).alias("delivered"), "source")))


SEG_BYTES = 16384
RETAIN_BYTES = 65536


def _segments(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").cast("bigint").alias("n_bytes"))
    return tp.assign_segment(d, "source", ["doc_id"], "n_bytes", SEG_BYTES)


SEGMENT_SQL = f"""
seg AS (
  SELECT doc_id, source, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes,
         CAST(floor(coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {SEG_BYTES}) AS BIGINT) AS segment
  FROM documents)
"""


@query("assign_segment", f"WITH {SEGMENT_SQL} SELECT doc_id, source, n_bytes, segment FROM seg")
def q_assign_segment(spark, sf_dir):
    return _segments(spark, sf_dir)


@query("roll_segments", f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents),
o AS (SELECT *, row_number() OVER w - 1 AS i, sum(n_bytes) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM d
      WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
jump AS (SELECT a.source, a.i, min(b.i) AS nxt FROM o a JOIN o b
         ON a.source = b.source AND b.i > a.i AND b.upto - (a.upto - a.n_bytes) > {SEG_BYTES} GROUP BY a.source, a.i),
roll AS (SELECT DISTINCT source, 0::BIGINT AS i, 0::BIGINT AS segment FROM o
         UNION ALL SELECT r.source, j.nxt, r.segment + 1 FROM roll r JOIN jump j ON r.source = j.source AND r.i = j.i)
SELECT o.doc_id, o.source, o.n_bytes, max(r.segment) AS segment
FROM o JOIN roll r ON o.source = r.source AND r.i <= o.i GROUP BY ALL
""")
def q_roll_segments(spark, sf_dir):
    """Documents per source in segments as a log rolls them: the first one that doesn't fit
    any more begins the next."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").cast("bigint").alias("n_bytes"))
    return tp.roll_segments(d, "source", ["doc_id"], "n_bytes", SEG_BYTES)


FLUSH_N, FLUSH_HOURS = 25, 12


@query("flush_batches", f"""
WITH RECURSIVE {TOPIC_SQL},
o AS (SELECT partition, "offset" AS i, timestamp AS ts, event_id FROM topic_o),
within AS (SELECT *, count(*) OVER (PARTITION BY partition) AS n, count(*) OVER (PARTITION BY partition ORDER BY ts
           RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL {FLUSH_HOURS} HOUR FOLLOWING) AS upto FROM o),
jump AS (SELECT partition, i, least(i + {FLUSH_N}, upto) AS nxt FROM within WHERE least(i + {FLUSH_N}, upto) < n),
roll AS (SELECT DISTINCT partition, 0::BIGINT AS i, 0::BIGINT AS flush FROM o
         UNION ALL SELECT r.partition, j.nxt, r.flush + 1 FROM roll r JOIN jump j ON r.partition = j.partition AND r.i = j.i),
n AS (SELECT o.partition, o.i, o.ts, o.event_id, max(r.flush) AS flush
      FROM o JOIN roll r ON o.partition = r.partition AND r.i <= o.i GROUP BY ALL)
SELECT partition, flush, count(*) AS n_records, min(i) AS first_offset, max(i) AS last_offset, min(ts) AS first_ts,
       CASE WHEN count(*) = {FLUSH_N} THEN 'messages' ELSE 'time' END AS rule
FROM n GROUP BY partition, flush
""")
def q_flush_batches(spark, sf_dir):
    """The topic's records in flushes of 25 messages or 12 hours, whichever comes first."""
    recs = topic_frame(spark, sf_dir, keep=["timestamp"])
    flushed = tp.flush_batches(recs, "partition", ["offset"], "timestamp", FLUSH_N, FLUSH_HOURS * 3_600_000)
    n = F.count("*")
    return flushed.groupBy("partition", "flush").agg(
        n.alias("n_records"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"),
        F.min("timestamp").alias("first_ts"), F.when(n == FLUSH_N, "messages").otherwise("time").alias("rule"))


@query("retain_by_size", f"""
WITH {SEGMENT_SQL},
s AS (SELECT source, segment, sum(n_bytes) AS b FROM seg GROUP BY source, segment),
k AS (SELECT source, segment FROM s
      QUALIFY coalesce(sum(b) OVER (PARTITION BY source ORDER BY segment DESC
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {RETAIN_BYTES})
SELECT doc_id, source, n_bytes, segment FROM seg SEMI JOIN k USING (source, segment)
""")
def q_retain_by_size(spark, sf_dir):
    return tp.retain_by_size(_segments(spark, sf_dir), "source", "segment", "n_bytes", RETAIN_BYTES)


RETAIN_HOURS = 24


@query("retain_by_time", f"""
SELECT event_id, ts, user_id FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {RETAIN_HOURS} HOUR
""")
def q_retain_by_time(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return tp.retain_by_time(ev, "ts", RETAIN_HOURS)


SEG_RETAIN_HOURS = 72


@query("retain_segments_by_time", f"""
WITH {TOPIC_SQL},
d AS (SELECT partition, "offset", timestamp, date_trunc('day', timestamp) AS segment FROM topic_o),
s AS (SELECT partition, segment, max(timestamp) AS m FROM d GROUP BY ALL)
SELECT partition, "offset", timestamp, segment FROM d SEMI JOIN
  (SELECT partition, segment FROM s WHERE m >= (SELECT max(m) FROM s) - INTERVAL {SEG_RETAIN_HOURS} HOUR) k
  USING (partition, segment)
""")
def q_retain_segments_by_time(spark, sf_dir):
    t = topic_frame(spark, sf_dir, keep=[]).select("partition", "offset", "timestamp",
                                          # wall-clock days whatever the session time zone
                                          F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("segment"))
    return tp.retain_segments_by_time(t, "partition", "segment", "timestamp", SEG_RETAIN_HOURS)


@query("describe_topic", f"""
WITH {TOPIC_SQL}
SELECT partition, count(*) AS n_records, min("offset") AS first_offset, max("offset") AS last_offset,
       min(timestamp) AS first_ts, max(timestamp) AS last_ts,
       CAST(sum(octet_length(encode(value))) AS BIGINT) AS n_bytes
FROM topic_o GROUP BY partition
""")
def q_describe_topic(spark, sf_dir):
    return tp.describe_topic(topic_frame(spark, sf_dir, keep=["value"]))
