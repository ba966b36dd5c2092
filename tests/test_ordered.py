"""Distributed ordered scans against pandas brute force: hot keys, null
keys, ties, many slices, Arrow batch carries."""

import datetime as dt
import decimal
import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shardline.operators.ordered import dense_index, gap_sessions, prefix_sum


def _rows(n, seed, hot_share=0.4):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = 0 if rnd.random() < hot_share else rnd.choice([1, 2, 3, None])
        rows.append((k, rnd.randint(0, 50), i, rnd.randint(0, 9)))
    return rows


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_dense_index_matches_row_number(spark, small_batches, parts):
    rows = _rows(400, parts)
    df = spark.createDataFrame(rows, "k int, t int, id int, v int")
    got = dense_index(df, ["k"], ["t", "id"], "idx", num_partitions=parts).toPandas()
    pdf = pd.DataFrame(rows, columns=["k", "t", "id", "v"])
    pdf["kk"] = pdf["k"].fillna(-99)
    pdf["want"] = pdf.sort_values(["kk", "t", "id"]).groupby("kk").cumcount()
    m = got.merge(pdf[["id", "want"]], on="id")
    assert len(m) == 400
    assert (m["idx"] == m["want"]).all()


@pytest.mark.parametrize("parts", [1, 5])
def test_prefix_sum_matches_window(spark, small_batches, parts):
    rows = _rows(300, 10 + parts)
    df = spark.createDataFrame(rows, "k int, t int, id int, v int")
    got = prefix_sum(df, ["k"], ["t", "id"], "v", "before", num_partitions=parts).toPandas()
    pdf = pd.DataFrame(rows, columns=["k", "t", "id", "v"])
    pdf["kk"] = pdf["k"].fillna(-99)
    s = pdf.sort_values(["kk", "t", "id"])
    s["want"] = s.groupby("kk")["v"].cumsum() - s["v"]
    m = got.merge(s[["id", "want"]], on="id")
    assert len(m) == 300
    assert (m["before"] == m["want"]).all()


def test_prefix_sum_descending_order(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 7), (1, 3, 11), (2, 1, 3)], "k int, s int, b int")
    got = {(r.k, r.s): r.before for r in prefix_sum(df, ["k"], [F.col("s").desc()], "b", "before").collect()}
    assert got == {(1, 3): 0, (1, 2): 11, (1, 1): 18, (2, 1): 0}


def _sessions_bruteforce(events, gap):
    out = {}
    by = {}
    for u, ts, i in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        by.setdefault(u, []).append((ts, i))
    for u, evs in by.items():
        n, prev = 0, None
        for ts, i in evs:
            if prev is None or (ts - prev).total_seconds() > gap:
                n += 1
            out[i] = n
            prev = ts
    return out


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_gap_sessions_match_bruteforce(spark, small_batches, parts):
    rnd = random.Random(parts)
    base = dt.datetime(2024, 1, 1)
    events, t = [], {}
    for i in range(500):
        u = 0 if rnd.random() < 0.5 else rnd.randint(1, 4)
        # steps of 0..90 minutes, including exactly one gap (60 minutes)
        t[u] = t.get(u, base) + dt.timedelta(minutes=rnd.choice([0, 5, 30, 60, 61, 90]))
        events.append((u, t[u], i))
    df = spark.createDataFrame(events, "u int, ts timestamp_ntz, id int")
    got = {r.id: r.session_no for r in gap_sessions(df, ["u"], "ts", 3600, tiebreak=["id"],
                                                      num_partitions=parts).collect()}
    assert got == _sessions_bruteforce(events, 3600)


def test_session_gap_boundary(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, base, 0), (1, base + dt.timedelta(hours=1), 1), (1, base + dt.timedelta(hours=2, seconds=1), 2)]
    df = spark.createDataFrame(rows, "u int, ts timestamp_ntz, id int")
    got = {r.id: r.session_no for r in gap_sessions(df, ["u"], "ts", 3600, tiebreak=["id"]).collect()}
    # exactly one gap later stays in the session; more than a gap opens a new one
    assert got == {0: 1, 1: 1, 2: 2}


def test_many_keys_correction_table_is_bounded(spark):
    """A hot key spanning every slice plus many small keys: still exact."""
    rows = [(0, i, i) for i in range(300)] + [(k, 0, 1000 + k) for k in range(1, 200)]
    df = spark.createDataFrame(rows, "k int, t int, id int")
    got = {r.id: r.idx for r in dense_index(df, ["k"], ["t", "id"], "idx", num_partitions=7).collect()}
    assert all(got[i] == i for i in range(300))
    assert all(got[1000 + k] == 0 for k in range(1, 200))


def test_empty_input(spark):
    df = spark.createDataFrame([], "k int, t int, v int")
    assert dense_index(df, ["k"], ["t"]).count() == 0
    assert dense_index(df, ["k"], ["t"]).count() == 0
    assert prefix_sum(df, ["k"], ["t"], "v", "b").count() == 0


def test_hot_key_is_cut_across_slices(spark):
    """One key with 90% of the rows lands in many range slices, not one task."""
    from shardline.operators.ordered import _slices
    rows = [(0, i) for i in range(900)] + [(k, 0) for k in range(1, 101)]
    df = spark.createDataFrame(rows, "k int, t int")
    sliced = _slices(df, ["k"], ["t"], 8)
    parts = {r._sl_pid for r in sliced.filter("k = 0").select("_sl_pid").distinct().collect()}
    assert len(parts) >= 6


def test_null_times_and_big_values(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, base, 0), (1, None, 1), (1, base + dt.timedelta(hours=3), 2)],
                               "u int, ts timestamp_ntz, id int")
    got = {r.id: r.session_no for r in gap_sessions(df, ["u"], "ts", 3600, tiebreak=["id"]).collect()}
    assert got == {0: 1, 1: None, 2: 2}
    big = 2 ** 60
    vals = spark.createDataFrame([(1, 0, big), (1, 1, None), (1, 2, 3), (1, 3, 1)], "k int, t int, v long")
    got = {r.t: r.b for r in prefix_sum(vals, ["k"], ["t"], "v", "b").collect()}
    assert got == {0: 0, 1: big, 2: big, 3: big + 3}


WIDE = "k long, t timestamp_ntz, id long, v decimal(20,2), d double"


@pytest.fixture()
def wide(spark):
    """Ids and keys above 2**53 beside nulls, decimals, times of years 1500 and 9999."""
    big = 1 << 60
    rows = []
    for i in range(60):
        key = [big + 1, big + 2, big + 3, None][i % 4]
        year = [1500, 2024, 9999][i % 3]
        rows.append((key, dt.datetime(year, 1, 1, 0, 0, i), None if i % 7 == 0 else big + i,
                     None if i % 11 == 0 else decimal.Decimal("90071992547409930.01") + i, float("nan") if i % 13 == 0 else i / 3))
    return spark.createDataFrame(rows, WIDE)


@pytest.mark.parametrize("parts", [1, 5])
def test_wide_values_equal_a_window(spark, small_batches, wide, parts):
    w = Window.partitionBy("k").orderBy("t", "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    got = prefix_sum(wide, ["k"], ["t", "id"], "v", "s", num_partitions=parts)
    zero = F.lit(0).cast("decimal(38,2)")
    want = wide.withColumn("s", F.coalesce(F.sum("v").over(before), zero).cast("decimal(38,2)"))
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == 60
    assert dict(got.dtypes)["v"] == "decimal(20,2)"
    got = dense_index(wide, ["k"], ["t", "id"], "i", num_partitions=parts)
    want = wide.withColumn("i", (F.row_number().over(w) - 1).cast("long"))
    assert got.select(want.columns).exceptAll(want).count() == 0
    got = gap_sessions(wide, ["k"], "t", 3600, tiebreak=["id"], num_partitions=parts).select("k", "id", "v", "session_no")
    us = F.unix_micros(F.col("t").cast("timestamp"))
    new = F.coalesce((us - F.lag(us).over(w) > 3_600_000_000).cast("int"), F.lit(1))
    want = (wide.withColumn("new", new)
            .select("k", "id", "v", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("session_no")))
    assert got.exceptAll(want).count() == 0 and got.count() == 60


def test_float_and_binary_keys(spark, small_batches):
    rows = [(float("nan"), b"a", i) for i in range(10)] + [(None, None, i) for i in range(10)] + [(0.5, b"b", i) for i in range(10)]
    df = spark.createDataFrame(rows, "k double, b binary, i int").withColumn("one", F.lit(1))
    for keys in (["k"], ["b"], ["k", "b"]):
        got = prefix_sum(df, keys, ["i"], "one", "n", num_partitions=3)
        assert got.filter("n <> i").count() == 0


# -- greedy rolls ---------------------------------------------------------------

def _sequential_roll(rows, max_bytes, max_count, max_micros):
    """One key's records in order, one after the other."""
    out, seg, used, n, first = [], -1, 0, 0, None
    for size, t in rows:
        over = (seg < 0 or (max_bytes is not None and used + (size or 0) > max_bytes) or (max_count is not None and n >= max_count)
                or (max_micros is not None and first is not None and t is not None and t - first > max_micros))
        if over:
            seg, used, n, first = seg + 1, 0, 0, t
        used, n = used + (size or 0), n + 1
        out.append(seg)
    return out


@pytest.mark.parametrize("slices,limits", [
    (1, (60, 5, 40)), (2, (100, None, None)), (3, (None, 7, None)), (4, (None, None, 50)), (5, (1, None, None)), (6, (100, None, 30)),
    (7, (3000, None, None)), (8, (60, 5, 40)), (9, (60, 5, 40)), (9, (3000, None, None))])
def test_greedy_roll_equals_a_sequential_one(spark, slices, limits):
    """A hot key, small ones, a null key; segments of one record, of many slices, and oversized records."""
    from shardline.operators.roll import greedy_roll
    rng = random.Random(slices * 31 + sum(x or 0 for x in limits))
    rows, t = [], 0
    for i in range(260):
        key = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        t += rng.choice([0, 1, 3, 20])
        rows.append((i, key, rng.choice([None, 0, 1, 5, 20, 99, 250]) if limits[0] != 3000 else rng.randrange(60), t))
    df = spark.createDataFrame(rows, "i int, k string, size int, t long").repartition(4)
    got = {r.i: r.segment for r in greedy_roll(df, "k", ["i"], size="size", max_bytes=limits[0], max_count=limits[1], time_us="t",
                                               max_micros=limits[2], num_partitions=slices).collect()}
    want = {}
    for key in ("hot", "a", "b", None):
        own = [r for r in rows if r[1] == key]
        want |= dict(zip((r[0] for r in own), _sequential_roll([(r[2], r[3]) for r in own], *limits)))
    assert got == want
