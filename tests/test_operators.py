"""Hand-built edge rows per operator: empty input, null key, one row, ties,
exact limits, missing/second '=', bad slot counts, empty query string."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shardline.functions import scalars as sc
from shardline.operators import relational as rel
from shardline.operators import topic as tp
from shardline.sources.text_inputs import (open_field, parse_open_json, parse_trace, read_json_records,
                                           scan_config, scan_properties, scan_traces, schema_of_records,
                                           split_pairs, variant_kind)


def test_shard_is_stable_and_in_range(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "key string")
    rows = tp.assign_shard(df, "key", 4).collect()
    assert all(0 <= r.partition < 4 for r in rows)
    assert rows[0].partition == rows[1].partition
    assert spark.createDataFrame([], "key string").transform(lambda d: tp.assign_shard(d, "key", 4)).count() == 0


def test_offsets_with_ties_and_start(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(0, t0, 2, 10), (0, t0, 1, 10), (1, t0, 3, None)],
                               "partition int, timestamp timestamp_ntz, id int, _start long")
    got = {r.id: r.offset for r in tp.assign_offset(df, "partition", ["timestamp", "id"], start_col="_start").collect()}
    assert got == {1: 10, 2: 11, 3: 0}


def test_size_limit_exact_boundary(spark):
    df = spark.createDataFrame([("x" * 10,), ("x" * 11,), ("é" * 5,), (None,)], "v string")
    ok, bad = tp.size_limit(df, "v", 10)
    assert sorted(r.v for r in ok.collect()) == ["x" * 10, "é" * 5]   # 10 bytes each
    assert sorted((r.v or "") for r in bad.collect()) == ["", "x" * 11]
    assert ok.count() + bad.count() == df.count()


def test_segments_and_size_retention(spark):
    df = spark.createDataFrame([("s", i, 4) for i in range(10)], "src string, i int, n long")
    seg = tp.assign_segment(df, "src", ["i"], "n", 10)
    got = {r.i: r.segment for r in seg.collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 2, 7: 2, 8: 3, 9: 3}
    kept = tp.retain_by_size(seg, "src", "segment", "n", 12)
    # segment 3 (8 bytes) and 2 (12 bytes newer-than 1 is 20 >= 12: dropped)
    assert sorted(r.i for r in kept.collect()) == [5, 6, 7, 8, 9]


def test_retain_by_time_counts_from_newest(spark):
    t0 = dt.datetime(2024, 1, 2)
    df = spark.createDataFrame([(t0,), (t0 - dt.timedelta(hours=24),), (t0 - dt.timedelta(hours=24, seconds=1),)],
                               "ts timestamp_ntz")
    assert tp.retain_by_time(df, "ts", 24).count() == 2


def test_decode_roundtrip_long_text(spark):
    text = "héllo " * 500
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(sc.decode_payload(sc.encode_payload("t")).alias("d")).first().d == text


def test_normalize_status_rules(spark):
    hdr = "JOBID PARTITION NAME USER ST TIME\n"
    cases = {
        hdr + "  1 p n u R 0:01\n": "Running",
        hdr + "1 p n u cd 0:01\n": "Done",
        hdr + "1 p n u CF 0:01\n": "Done",
        hdr + "1 p n u CG 0:01\n": "Done",
        hdr + "1 p n u PD 0:01\n": "Queue",
        hdr + "1 p n u F 0:01\n": "Unknown",
        "1 p n u R 0:01": "Unknown",          # one piece: no second-last
        hdr + "1 p n u R 0:01": "Unknown",    # second-last is the header
        "\n": "Unknown",
        "": "Unknown",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.s for r in df.select("t", sc.normalize_status("t").alias("s")).collect()}
    assert got == cases
    assert spark.createDataFrame([(None,)], "t string").select(sc.normalize_status("t").alias("s")).first().s == "Unknown"


def test_url_parts(spark):
    df = spark.createDataFrame([("ssh://alice@Host.Example.org:22/x",), ("slurm+ssh://login1/",), ("nohost",)], "u string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in sc.parse_endpoints("u").items()]).collect()]
    assert got == [("ssh", "host.example.org", "alice"), ("slurm+ssh", "login1", None), (None, None, None)]


def test_extract_pattern_no_match_is_null(spark):
    df = spark.createDataFrame([("Submitted batch job 123",), ("nothing",)], "s string")
    got = [r.j for r in df.select(sc.extract_pattern("s", r"batch job ([0-9]+)").alias("j")).collect()]
    assert got == ["123", None]


def test_format_duration_no_padding(spark):
    df = spark.createDataFrame([(59,), (61,), (0,), (600,)], "m int")
    assert [r.d for r in df.select(sc.format_duration("m").alias("d")).collect()] == ["0:59:00", "1:1:00", "0:0:00", "10:0:00"]


def test_key_values_edges(spark):
    df = spark.createDataFrame([(1, "a=1&b&c=x=y&&zoo.connect=h:2181"), (2, "")], "id int, q string")
    got = sorted((r.id, r.key, r.value) for r in split_pairs(df, "q", "&", keep=["id"]).collect())
    assert got == [(1, "a", "1"), (1, "b", None), (1, "c", "x=y"), (1, "zoo.connect", "h:2181")]
    pref = split_pairs(df, "q", "&", prefixes=["zoo.conn"], keep=["id"]).collect()
    assert [(r.key, r.value) for r in pref] == [("zoo.connect", "h:2181")]


def test_properties_files(spark, tmp_path):
    (tmp_path / "a.properties").write_text("# comment\nbroker.id=0\nzookeeper.connect=h1:2181\n\n")
    (tmp_path / "b.properties").write_text("broker.id=1\nzookeeper.connection.timeout.ms=6000\n")
    rows = scan_properties(spark, str(tmp_path), ["broker.id", "zookeeper.connect"]).collect()
    got = sorted((r.file.rsplit("/", 1)[-1], r.key, r.value) for r in rows)
    assert got == [("a.properties", "broker.id", "0"), ("a.properties", "zookeeper.connect", "h1:2181"),
                   ("b.properties", "broker.id", "1"), ("b.properties", "zookeeper.connection.timeout.ms", "6000")]


def test_trace_layouts(spark):
    df = spark.createDataFrame([("download, 2, 1.50000",), ("startup,spark, 4, 3.25",), ("bad line",)], "l string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in parse_trace("l").items()]).collect()]
    assert got == [("download", None, 2, 1.5), ("startup", "spark", 4, 3.25), (None, None, None, None)]


def test_expand_slots_bad_counts(spark):
    df = spark.createDataFrame([("h1", "2"), ("h2", "0"), ("h3", "x"), ("h4", "-1"), ("h5", None)], "host string, slots string")
    assert sorted((r.host, r.slot) for r in rel.expand_slots(df, "host", "slots").collect()) == [("h1", 1), ("h1", 2)]


def test_expand_ranges(spark):
    df = spark.createDataFrame([(1, "n[01-03,07],m5"), (2, "a[9-11]"), (3, "x[5-2]"), (4, "n[01-02,01]")], "id int, e string")
    got = sorted((r.id, r.host) for r in rel.expand_ranges(df, "e").collect())
    assert got == [(1, "m5"), (1, "n01"), (1, "n02"), (1, "n03"), (1, "n07"),
                   (2, "a10"), (2, "a11"), (2, "a9"), (4, "n01"), (4, "n02")]


def test_expand_ranges_products(spark):
    """Several groups in one item: all combinations, each with its own padding."""
    rows = [(1, "n[1-2]r[3-4]"), (2, "a[08-10]b[1,3]c"), (3, "x[1-2][1-2]"), (4, "r[1-3]u[5-2],ok"), (5, "p[]q[1-2]"),
            (6, "w[0-65535]v[0-65535]"), (7, "t[1-2]u[1-2147483647]"), (8, "]k[1-2"), (9, "")]
    df = spark.createDataFrame(rows, "id int, e string")
    members, rejected = rel.expand_ranges_split(df.filter("id <> 6"), "e", chunk=3)
    got = {}
    for r in members.collect():
        got.setdefault(r.id, set()).add(r.host)
    assert got == {1: {"n1r3", "n1r4", "n2r3", "n2r4"}, 2: {f"a{i}b{j}c" for i in ("08", "09", "10") for j in (1, 3)},
                   3: {"x11", "x12", "x21", "x22"}, 4: {"ok"}, 8: {"k", "1-2"}}
    rejected = rel.expand_ranges_split(df, "e")[1]
    assert sorted((r.id, r.item, r.reason) for r in rejected.collect()) == [
        (4, "r[1-3]u[5-2]", "no member"), (5, "p[]q[1-2]", "no member"), (6, "w[0-65535]v[0-65535]", "too many"),
        (7, "t[1-2]u[1-2147483647]", "too many")]


def test_expand_slots_rejects(spark):
    rows = [("a", "2"), ("b", "0"), ("c", "x"), ("d", None), ("e", "2147483648"), ("f", "99999999999999999999"), ("g", "-3"), ("h", "007")]
    slots, rejected = rel.expand_slots_split(spark.createDataFrame(rows, "host string, slots string"), "host", "slots")
    kept = {r.host: r.n for r in slots.groupBy("host").agg(F.count("*").alias("n")).collect()}
    assert kept == {"a": 2, "h": 7}
    assert {r.host: r.reason for r in rejected.collect()} == {
        "b": "not a count", "c": "not a count", "d": "not a count", "e": "too many", "f": "too many", "g": "not a count"}


def _chain(spark, rows):
    df = spark.createDataFrame(rows, "id int, parent int, own string, value string").repartition(3)
    return {r.value: (r.endpoint, r.root, r.hops, r.cycle) for r in rel.lookup_chain(df, "id", "parent", "own").collect()}


@pytest.mark.parametrize("length", [1, 2, 3, 1000])
def test_lookup_chain_of_any_length(spark, length):
    """Everyone gets the value of the first job, and a hot root is no different."""
    rows = [(i, i - 1 if i else None, f"own{i}", str(i)) for i in range(length)]
    rows += [(5000 + i, 0, "leaf", f"leaf{i}") for i in range(50)]
    got = _chain(spark, rows)
    assert got == {**{str(i): ("own0", 0, i, False) for i in range(length)},
                   **{f"leaf{i}": ("own0", 0, 1, False) for i in range(50)}}


def test_lookup_chain_edges(spark):
    rows = [(1, None, "one", "a"), (2, 99, "two", "unknown parent"), (3, 2, "three", "b"), (None, 3, "nameless", "no id"),
            (10, 11, "x", "loop1"), (11, 12, "y", "loop2"), (12, 10, "z", "loop3"), (13, 12, "w", "into a loop"),
            (14, 14, "s", "own parent"), (20, 1, "r", "repeated"), (20, None, "q", "repeated root"), (21, 20, "t", "below repeated"),
            (22, None, None, "null value"), (23, 22, "v", "of a null value")]
    got = _chain(spark, rows)
    loop = (None, None, None, True)
    assert got == {"a": ("one", 1, 0, False), "unknown parent": ("two", 2, 0, False), "b": ("two", 2, 1, False),
                   "no id": ("two", 2, 2, False), "loop1": loop, "loop2": loop, "loop3": loop, "into a loop": loop,
                   "own parent": loop, "repeated": ("one", 1, 1, False), "repeated root": ("q", 20, 0, False),
                   "below repeated": ("q", 20, 1, False), "null value": (None, 22, 0, False), "of a null value": (None, 22, 1, False)}
    empty = spark.createDataFrame([], "id int, parent int, own string")
    assert rel.lookup_chain(empty, "id", "parent", "own").count() == 0


def test_lookup_parent_edges(spark):
    kids = spark.createDataFrame([(1, None, "own1"), (2, 10, "own2"), (3, 99, "own3")], "id int, parent int, own string")
    parents = spark.createDataFrame([(10, "p10")], "pid int, ep string")
    got = {r.id: r.endpoint for r in rel.lookup_parent(kids, parents, "parent", "pid", "own", "ep").collect()}
    assert got == {1: "own1", 2: "p10", 3: "own3"}


def test_single_attachment_and_all_in_state(spark):
    att = spark.createDataFrame([(1, 5, "s1"), (2, 1, "s2"), (2, 2, "s3")], "vol int, n int, server string")
    one = rel.single_attachment(att, "vol", ["n"], ["server"]).collect()
    assert [(r.vol, r.server) for r in one] == [(1, "s1")]
    groups = spark.createDataFrame([(1,), (2,), (3,)], "g int")
    mem = spark.createDataFrame([(1, "done"), (1, "done"), (2, "done"), (2, None)], "g int, st string")
    got = {r.g: r.all_in_state for r in rel.all_in_state_for(groups, "g", mem, "st", "done").collect()}
    assert got == {1: True, 2: False, 3: True}


def test_rebase_ids_trailing_digits(spark):
    existing = spark.createDataFrame([("a", "broker-12"), ("a", "broker-3"), ("b", "broker-x")], "g string, name string")
    new = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1), ("c", 1)], "g string, k int")
    got = {(r.g, r.k): r.new_id for r in rel.rebase_ids(new, existing, "g", "name", ["k"]).collect()}
    assert got == {("a", 1): 13, ("a", 2): 14, ("b", 1): 1, ("c", 1): 1}


def test_latest_by_ties(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t0, 1), (1, t0, 2), (2, t0, 3)], "u int, ts timestamp_ntz, id int")
    got = {r.u: r.id for r in rel.latest_by(df, "u", ["ts", "id"], ["id"]).collect()}
    assert got == {1: 2, 2: 3}


def test_distinct_members_trims(spark):
    df = spark.createDataFrame([("n1\n",), ("n1",), (" n2 ",)], "h string")
    assert sorted(r.h for r in rel.distinct_members(df, "h").collect()) == ["n1", "n2"]


def test_overlay_map_given_wins(spark):
    df = spark.createDataFrame([({"queue": "gpu"},), (None,)], "m map<string,string>")
    got = [r.o for r in df.select(rel.overlay_map("m", {"queue": "normal", "walltime": "10"}).alias("o")).collect()]
    assert got == [{"queue": "gpu", "walltime": "10"}, {"queue": "normal", "walltime": "10"}]


def test_overlay_map_needs_no_session_setting(spark):
    key = "spark.sql.mapKeyDedupPolicy"
    old = spark.conf.get(key)
    spark.conf.set(key, "EXCEPTION")
    try:
        test_overlay_map_given_wins(spark)
    finally:
        spark.conf.set(key, old)


def test_impossible_ranges_do_not_fail_the_job(spark):
    rows = [(1, "n[0-9223372036854775807],m[1-2]"), (2, "n[1-9223372036854775807]"), (3, "x[9223372036854775806-9223372036854775807]"),
            (4, "y[5-3]"), (5, "z[99999999999999999999]"), (6, None)]
    df = spark.createDataFrame(rows, "id int, e string")
    got = sorted((r.id, r.host) for r in rel.expand_ranges(df, "e").collect())
    assert got == [(1, "m1"), (1, "m2"), (3, "x9223372036854775806"), (3, "x9223372036854775807")]
    slots = spark.createDataFrame([("a", "2147483647"), ("b", "2"), ("c", "2147483648"), ("d", "-1"), ("e", None)],
                                  "host string, slots string")
    assert rel.expand_slots(slots.filter("host <> 'a'"), "host", "slots").count() == 2
    assert rel.expand_slots(slots, "host", "slots").limit(1000).count() == 1000
    wide = spark.createDataFrame([(0, 9223372036854775807), (1, 5), (None, 3)], "lo long, hi long")
    assert [(r.lo, r.hi) for r in rel.range_rejects(wide, "lo", "hi").collect()] == [(0, 9223372036854775807)]


def test_expansion_is_spread_over_all_tasks(spark):
    key = "spark.sql.adaptive.enabled"
    spark.conf.set(key, "false")
    try:
        df = spark.createDataFrame([(f"h{i}", "300") for i in range(200)], "host string, slots string")
        out = rel.expand_slots(df, "host", "slots", chunk=100).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set(key, "true")
    assert sum(r["count"] for r in out) == 60_000 and len(out) == 8 and max(r["count"] for r in out) < 15_000


def test_placed_shards_have_a_partition_each(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("key"))
    placed = tp.assign_shard(df, "key", 4, place=True)
    got = rel.placement_profile(placed).collect()
    want = {r.partition: r["count"] for r in placed.groupBy("partition").count().collect()}
    assert {r.partition_id: r.n_rows for r in got} == want and all(r.host for r in got)
    assert abs(sum(r.skew for r in got) - len(got)) < 1e-9


def test_bad_payloads_are_marked(spark):
    from shardline.functions import scalars as sc
    rows = [(1, "aGk="), (2, "@@@"), (3, "/w=="), (4, None), (5, ""), (6, "aGFs\r\nbG8=")]
    df = spark.createDataFrame(rows, "id int, d string")
    got = {r.id: (r.t, r.bad) for r in df.select("id", sc.decode_payload("d").alias("t"), sc.bad_payload("d").alias("bad")).collect()}
    assert got == {1: ("hi", False), 2: (None, True), 3: (None, True), 4: (None, False), 5: ("", False), 6: ("hallo", False)}


def test_hosts_and_empty_matches(spark):
    from shardline.functions import scalars as sc
    df = spark.createDataFrame([("http://[::1]:8080/x",), ("https://u:p@Host.org:1/y",), ("no url",)], "u string")
    assert [r.h for r in df.select(sc.url_host("u").alias("h")).collect()] == ["[::1]", "host.org", None]
    df = spark.createDataFrame([("k=",), ("k=v",), ("other",), (None,)], "s string")
    assert [r.m for r in df.select(sc.extract_pattern("s", "k=(.*)").alias("m")).collect()] == ["", "v", None, None]
    df = spark.createDataFrame([(59,), (61,), (-1,), (None,)], "m int")
    assert [r.d for r in df.select(sc.format_duration("m").alias("d")).collect()] == ["0:59:00", "1:1:00", "-1:59:00", None]


def test_gather_is_whole_or_refused(spark):
    from shardline.sources.sinks import gather
    assert len(gather(spark.range(100), 100)) == 100
    with pytest.raises(ValueError, match="more than 100"):
        gather(spark.range(101), 100)


def test_parallelize(spark):
    from shardline.sources.parallel import parallelize
    assert sorted(r.value for r in parallelize(spark, 5).collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.value for r in parallelize(spark, ["a", "b"], 2).collect()) == ["a", "b"]
    assert parallelize(spark, []).count() == 0 and parallelize(spark, 10, 3).rdd.getNumPartitions() == 3


def test_python_handlers_get_exact_values(spark):
    import decimal
    from shardline.streaming.handlers import handle_batches
    big = (1 << 60) + 1
    df = spark.createDataFrame([(0, i, None if i == 3 else big + i, decimal.Decimal("1.10")) for i in range(7)],
                               "partition int, offset long, id long, d decimal(10,2)")

    def handler(pdf):
        return {"ids": [int(x) for x in pdf["id"].dropna()], "total": sum(pdf["d"], decimal.Decimal(0))}
    got = {r.batch: (r.ids, r.total) for r in handle_batches(df, handler, "ids array<long>, total decimal(12,2)", 5).collect()}
    assert got == {0: ([big, big + 1, big + 2, big + 4], decimal.Decimal("5.50")), 1: ([big + 5, big + 6], decimal.Decimal("2.20"))}
    frames = handle_batches(df, lambda pdf: pdf[["id"]], "id long", 5).collect()
    assert sorted((r.id for r in frames), key=str) == sorted([None if i == 3 else big + i for i in range(7)], key=str)


def test_chunked_expansion_is_exact(spark):
    df = spark.createDataFrame([("h1", "10"), ("h2", "3")], "host string, slots string")
    got = sorted((r.host, r.slot) for r in rel.expand_slots(df, "host", "slots", chunk=4).collect())
    assert got == [("h1", i) for i in range(1, 11)] + [("h2", 1), ("h2", 2), ("h2", 3)]
    r = spark.createDataFrame([(1, "a[001-010],b")], "id int, e string")
    hosts = sorted(x.host for x in rel.expand_ranges(r, "e", chunk=3).collect())
    assert hosts == ["a%03d" % i for i in range(1, 11)] + ["b"]


def test_config_yaml_and_xml(spark, tmp_path):
    (tmp_path / "conf.yaml").write_text("# flink\njobmanager.rpc.address: localhost\ntaskmanager.numberOfTaskSlots: 4\n")
    (tmp_path / "core-site.xml").write_text(
        "<configuration>\n <property>\n  <name>fs.default.name</name>\n  <value>hdfs://h:9000</value>\n"
        " </property>\n <property><name>io.file.buffer.size</name><value>131072</value></property>\n</configuration>\n")
    y = sorted((r.key, r.value) for r in scan_config(spark, str(tmp_path / "conf.yaml"), "yaml").collect())
    assert y == [("jobmanager.rpc.address", "localhost"), ("taskmanager.numberOfTaskSlots", "4")]
    x = sorted((r.key, r.value) for r in scan_config(spark, str(tmp_path / "core-site.xml"), "xml").collect())
    assert x == [("fs.default.name", "hdfs://h:9000"), ("io.file.buffer.size", "131072")]


def test_python_handler_batches(spark):
    from shardline.streaming.handlers import handle_batches
    rows = [(p, o, f"v{p}-{o}") for p in range(2) for o in range(23)]
    df = spark.createDataFrame(rows, "partition int, offset long, value string")
    def handler(b):
        return {"n": len(b), "first": int(b["offset"].iloc[0]), "last": int(b["offset"].iloc[-1])}
    for size in (1, 5):
        got = sorted(tuple(r) for r in handle_batches(df, handler, "n long, first long, last long", size).collect())
        want = sorted((p, o // size, min(size, 23 - (o // size) * size), o, min(o + size - 1, 22))
                      for p in range(2) for o in range(0, 23, size))
        assert got == want


def test_description_file_with_defaults(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n  "resource": "ssh://h1",\n  "number_cores": 4,\n  "type": "spark"\n}\n')
    (tmp_path / "b.json").write_text('{\n  "type": "kafka",\n  "walltime": "30"\n}\n')
    schema = "resource string, number_cores int, type string, walltime string, queue string"
    df = read_json_records(spark, str(tmp_path), schema, multi_line=True)
    filled = rel.overlay_defaults(df, {"resource": "fork://localhost", "number_cores": 1, "walltime": "10",
                                       "queue": "normal"}, casts={"walltime": "int"})
    got = sorted(tuple(r) for r in filled.select("type", "resource", "number_cores", "walltime", "queue").collect())
    assert got == [("kafka", "fork://localhost", 1, 30, "normal"), ("spark", "ssh://h1", 4, 10, "normal")]


def test_write_routes_one_folder_per_branch(spark, tmp_path):
    df = spark.createDataFrame([(1, "https://m.a"), (2, "http://b"), (3, "ftp://c")], "id int, url string")
    routed = rel.route(df, "url", [("https://m.", "mobile"), ("https://", "secure"), ("http://", "plain")])
    rel.write_routes(routed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.id, r.route) for r in back.collect()) == [(1, "mobile"), (2, "plain"), (3, "unsupported")]
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("route=")) == [
        "route=mobile", "route=plain", "route=unsupported"]


def test_trace_files_mixed_layouts(spark, tmp_path):
    (tmp_path / "kafka.csv").write_text("download, 2, 10.50000\nstartup, 2, 3.00000\n")
    (tmp_path / "spark.csv").write_text("download,spark, 4, 12.25000\n")
    got = sorted((tuple(r) for r in scan_traces(spark, str(tmp_path)).collect()), key=lambda t: (t[0], t[1] or ""))
    assert got == [("download", None, 2, 10.5), ("download", "spark", 4, 12.25), ("startup", None, 2, 3.0)]


def test_epoch_micros_ignores_session_zone_and_dst_gaps(spark):
    import datetime as _dt
    key = "spark.sql.session.timeZone"
    spark.conf.set(key, "America/New_York")
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00' AS a, TIMESTAMP_NTZ'2024-07-01 12:34:56.123456' AS b")
        r = df.select(sc.epoch_micros("a").alias("a"), sc.epoch_micros("b").alias("b")).first()
    finally:
        spark.conf.set(key, "UTC")
    epoch = _dt.datetime(1970, 1, 1)
    assert r.a == (_dt.datetime(2024, 3, 10, 2, 30) - epoch) // _dt.timedelta(microseconds=1)
    assert r.b == (_dt.datetime(2024, 7, 1, 12, 34, 56, 123456) - epoch) // _dt.timedelta(microseconds=1)


def test_xml_configuration_is_parsed(spark, tmp_path):
    """Comments, entities, CDATA, blanks and missing parts, over several files."""
    (tmp_path / "a.xml").write_text(
        "<?xml version='1.0'?>\n<configuration>\n<!-- <property><name>not</name><value>this</value></property> -->\n"
        "<property><name> spaced.key </name><value>a &lt; b &amp; c</value><final>true</final></property>\n"
        "<property><name>cdata</name><value><![CDATA[<x>=1]]></value></property>\n"
        "<property><name>empty</name><value></value></property><property><value>nameless</value></property>\n</configuration>")
    (tmp_path / "b.xml").write_text("<configuration><property>\n<name>cdata</name>\n<value>other file</value>\n</property></configuration>")
    got = sorted((r.file.rsplit("/", 1)[1], r.key, r.value or "") for r in scan_config(spark, str(tmp_path), "xml").collect())
    assert got == [("a.xml", "cdata", "<x>=1"), ("a.xml", "empty", ""), ("a.xml", "spaced.key", "a < b & c"),
                   ("b.xml", "cdata", "other file")]
    assert [r.key for r in scan_config(spark, str(tmp_path), "xml", ["sp"]).collect()] == ["spaced.key"]


def test_open_json_edges(spark):
    rows = [(1, '{"a": 1}'), (2, '{"a": '), (3, None), (4, ""), (5, '[1, "x", {"b": null}]'), (6, "null"), (7, "1.5"),
            (8, "true"), (9, '"text"'), (10, '{"a": {"b": ["deep"]}}'), (11, '{"a": 99999999999999999999}'), (12, "{} extra")]
    df = parse_open_json(spark.createDataFrame(rows, "id int, line string"), "line")
    got = {r.id: (r.kind, r.corrupt, r.a, r.deep) for r in df.select(
        "id", variant_kind("record").alias("kind"), "corrupt", open_field("record", "$.a", "int").alias("a"),
        open_field("record", "$.a.b[0]", "string").alias("deep")).collect()}
    assert got == {1: ("object", None, 1, None), 2: (None, '{"a": ', None, None), 3: (None, None, None, None), 4: (None, "", None, None),
                   5: ("array", None, None, None), 6: ("null", None, None, None), 7: ("number", None, None, None),
                   8: ("boolean", None, None, None), 9: ("string", None, None, None), 10: ("object", None, None, "deep"),
                   11: ("object", None, None, None), 12: ("object", None, None, None)}
    one = schema_of_records(df.filter("id IN (1, 10)")).first().schema
    assert one.startswith("OBJECT<a: VARIANT") and schema_of_records(df.filter("id = 1")).first().schema == "OBJECT<a: BIGINT>"


def test_json_corrupt_column(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1, "b": "t"}\n{"a": "no number", "b": "kept"}\n{"a": 2\n\n[3]\n')
    got = [(r.a, r.b, r.bad) for r in read_json_records(spark, str(tmp_path), "a int, b string", corrupt="bad").collect()]
    assert sorted(got, key=str) == sorted([(1, "t", None), (None, "kept", '{"a": "no number", "b": "kept"}'),
                                           (None, None, '{"a": 2'), (None, None, "[3]")], key=str)


def test_sql_calls_share_no_names(spark):
    """Two calls with one frame name, the second made before the first one runs."""
    from shardline.functions.udf import run_sql
    before = {t.name for t in spark.catalog.listTables()}
    one = run_sql(spark, {"t": spark.range(3)}, "SELECT count(*) AS n, :v AS v FROM {t}", {"v": "a'b"})
    two = run_sql(spark, {"t": spark.range(5)}, "SELECT count(*) AS n, :v AS v FROM {t}", {"v": 7})
    assert [tuple(x.first()) for x in (one, two, one)] == [(3, "a'b"), (5, 7), (3, "a'b")]
    assert {t.name for t in spark.catalog.listTables()} == before
