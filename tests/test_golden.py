"""
with their expected values worked out by hand."""

import datetime as dt

from pyspark.sql import functions as F

from shardline.functions.scalars import decode_payload, encode_payload
from shardline.operators.relational import map_values, placement_profile
from shardline.session import shared_path
from shardline.sources.sinks import gather
from shardline.sources.topic_log import read_topic, write_topic
from shardline.streaming.handlers import apply_native, batch_events


def test_squares_of_a_collection(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "value int")
    rows = gather(map_values(df, {"sq": F.col("value") * F.col("value")}).orderBy("sq"), 10)
    assert [r.sq for r in rows] == [1, 4, 9]


def test_squares_of_a_range(spark):
    sq = spark.range(10).select((F.col("id") * F.col("id")).alias("sq"))
    assert sorted(r.sq for r in gather(sq, 10)) == [0, 1, 4, 9, 16, 25, 36, 49, 64, 81]
    assert sq.agg(F.sum("sq")).first()[0] == 285


def test_keyed_record_round_trip(spark):
    path = shared_path(spark, "t-golden-topic")
    rec = spark.createDataFrame([("key", "Hello World", dt.datetime(2024, 1, 1))],
                                "key string, value string, timestamp timestamp_ntz")
    write_topic(rec, path, "test", 1)
    got = read_topic(spark, path).collect()
    assert [(r.topic, r.partition, r.offset, r.key, r.value) for r in got] == [("test", 0, 0, "key", "Hello World")]


def test_shard_record_decoded_by_handler(spark):
    rec = spark.createDataFrame([("A", "Hello World")], "partition_key string, text string")
    topic = rec.select(F.lit(0).alias("partition"), F.lit(0).cast("bigint").alias("offset"),
                       encode_payload("text").alias("value"))
    ev = batch_events(topic, batch_size=1)
    out = apply_native(ev, lambda records: {"decoded": F.transform(records, lambda r: decode_payload(r["kinesis"]["data"]))})
    assert out.first().decoded == ["Hello World"]


def test_task_spread_counts_every_task(spark):
    prof = placement_profile(spark.range(0, 10, 1, 10))
    rows = prof.collect()
    assert sum(r.n_rows for r in rows) == 10
    assert len(rows) == 10 and all(r.host for r in rows)
