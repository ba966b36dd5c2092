"""Queries for projection, routing, lookups, aggregates, latest/head, set
operations and expansion (operators 25-28, 30-34, 36-42)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shardline.operators import relational as rel
from shardline.plans.catalog import query
from shardline.operators.topic import assign_shard
from shardline.sources.tables import load


@query("map_values", """
SELECT l_orderkey, l_linenumber, CAST(l_linenumber * l_linenumber AS BIGINT) AS sq FROM lineitem
""")
def q_map_values(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return rel.map_values(li, {"sq": (F.col("l_linenumber") * F.col("l_linenumber")).cast("bigint")},
                          keep=["l_orderkey", "l_linenumber"])


@query("filter_prefix", """
WITH s AS (
  SELECT event_id, 'event.type' AS key, event_type AS value FROM events
  UNION ALL SELECT event_id, 'event.user', CAST(user_id AS VARCHAR) FROM events
  UNION ALL SELECT event_id, 'props.k', json_extract_string(props, '$.k') FROM events)
SELECT event_id, key, value FROM s WHERE starts_with(key, 'event.')
""")
def q_filter_prefix(spark, sf_dir):
    """Settings map per event, keep keys starting with ``event.``."""
    ev = load(spark, sf_dir, "events")
    m = F.create_map(F.lit("event.type"), F.col("event_type"),
                     F.lit("event.user"), F.col("user_id").cast("string"),
                     F.lit("props.k"), F.get_json_object("props", "$.k"))
    kept = ev.select("event_id", rel.filter_prefix_map(m, "event.").alias("settings"))
    return kept.select("event_id", F.explode("settings").alias("key", "value"))


@query("filter_prefix_rows", """
SELECT event_id, event_type FROM events WHERE starts_with(event_type, 'c')
""")
def q_filter_prefix_rows(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select("event_id", "event_type")
    return rel.filter_prefix(ev, "event_type", "c")


@query("overlay_defaults", """
SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def q_overlay_defaults(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id")
    lab = load(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "left")
    return rel.overlay_defaults(j, {"quality": 0, "toxic": 0}).select("doc_id", "quality", "toxic")


ROUTES = [("https://m.", "mobile"), ("https://", "secure"), ("http://", "plain")]


@query("overlay_map", """
SELECT page_id, CASE WHEN url LIKE '%page=%' THEN regexp_extract(url, 'page=([0-9]+)', 1) ELSE '1' END AS page,
       CASE WHEN url LIKE '%ref=%' THEN regexp_extract(url, 'ref=([^&#]*)', 1) ELSE 'none' END AS ref
FROM pages
""")
def q_overlay_map(spark, sf_dir):
    """Query-string entries of page URLs over default entries."""
    given = F.str_to_map(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit("&"), F.lit("="))
    m = rel.overlay_map(given, {"page": "1", "ref": "none"})
    return load(spark, sf_dir, "pages").select("page_id", m["page"].alias("page"), m["ref"].alias("ref"))


@query("route", """
SELECT page_id, CASE WHEN starts_with(url, 'https://m.') THEN 'mobile'
                     WHEN starts_with(url, 'https://') THEN 'secure'
                     WHEN starts_with(url, 'http://') THEN 'plain'
                     ELSE 'unsupported' END AS route
FROM pages
""")
def q_route(spark, sf_dir):
    return rel.route(load(spark, sf_dir, "pages").select("page_id", "url"), "url", ROUTES).select("page_id", "route")


@query("lookup_parent", """
SELECT s_suppkey, s_nationkey, coalesce(p.n_name, s_name) AS endpoint
FROM supplier LEFT JOIN (SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey
                         WHERE r_name = 'EUROPE') p ON s_nationkey = p.n_nationkey
""")
def q_lookup_parent(spark, sf_dir):
    """Suppliers whose nation is a known parent (nations of EUROPE) take the
    nation's name; the others keep their own name."""
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    parents = nation.join(region.filter(F.col("r_name") == "EUROPE"), nation.n_regionkey == region.r_regionkey)
    sup = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    return rel.lookup_parent(sup, parents, "s_nationkey", "n_nationkey", "s_name", "n_name") \
        .select("s_suppkey", "s_nationkey", "endpoint")


@query("lookup_parent_region", """
SELECT n_nationkey, n_regionkey, coalesce(r_name, n_name) AS endpoint
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
""")
def q_lookup_parent_region(spark, sf_dir):
    """Nations take their region's name as endpoint (every parent known)."""
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name")
    region = load(spark, sf_dir, "region")
    return rel.lookup_parent(nation, region, "n_regionkey", "r_regionkey", "n_name", "r_name") \
        .select("n_nationkey", "n_regionkey", "endpoint")


@query("match_single_attachment", """
WITH one AS (SELECT l_orderkey, min(l_linenumber) AS l_linenumber, min(l_partkey) AS l_partkey
             FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1)
SELECT o_orderkey, l_linenumber, l_partkey, c_custkey, c_name
FROM one JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
""")
def q_match_single_attachment(spark, sf_dir):
    """Orders with exactly one line item, matched to their customer."""
    li = load(spark, sf_dir, "lineitem")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    one = rel.match_single_attachment(li, "l_orderkey", ["l_linenumber"], ["l_partkey"],
                                      orders, "l_orderkey", "o_orderkey")
    return one.join(cust, one.o_custkey == cust.c_custkey).select("o_orderkey", "l_linenumber", "l_partkey",
                                                                   "c_custkey", "c_name")


@query("completeness", """
WITH exp AS (SELECT o_orderkey, coalesce(m, 0) AS expected FROM orders
             LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS m FROM lineitem GROUP BY 1) x ON o_orderkey = l_orderkey),
obs AS (SELECT l_orderkey AS o_orderkey, count(DISTINCT l_linenumber) AS observed FROM lineitem GROUP BY 1)
SELECT o_orderkey, expected, CAST(coalesce(observed, 0) AS BIGINT) AS observed,
       coalesce(coalesce(observed, 0) = expected, false) AS complete
FROM exp LEFT JOIN obs USING (o_orderkey)
""")
def q_completeness(spark, sf_dir):
    """Per order: are line numbers 1..max all present? One aggregation of lineitem
    gives the expected and the observed number."""
    li = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    both = li.groupBy("o_orderkey").agg(F.max("l_linenumber").alias("expected"),
                                        F.count_distinct("l_linenumber").alias("observed"))
    j = load(spark, sf_dir, "orders").select("o_orderkey").join(both, "o_orderkey", "left")
    return rel.mark_complete(j.withColumn("expected", F.coalesce("expected", F.lit(0))))


@query("all_in_state", """
SELECT o_orderkey, coalesce(a, true) AS all_in_state
FROM orders LEFT JOIN (SELECT l_orderkey, bool_and(coalesce(l_linestatus = 'F', false)) AS a
                       FROM lineitem GROUP BY l_orderkey) x ON o_orderkey = l_orderkey
""")
def q_all_in_state(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus")
    orders = load(spark, sf_dir, "orders").select("o_orderkey")
    return rel.all_in_state_for(orders, "o_orderkey", li, "l_linestatus", "F")


@query("placement_profile", """
WITH s AS (SELECT (('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8))::BIGINT % 4) AS shard, count(*) AS n
           FROM events GROUP BY 1)
SELECT CAST(shard AS INTEGER) AS partition_id, n AS n_rows, n / (SELECT avg(n) FROM s) AS skew, true AS has_host FROM s
""")
def q_placement_profile(spark, sf_dir):
    """Where did the records go after placing them by shard? Spark partition i holds
    shard i; the host depends on the cluster."""
    from shardline.plans.fixtures import topic_records
    placed = assign_shard(topic_records(spark, sf_dir), "key", 4, place=True)
    return rel.placement_profile(placed).select("partition_id", "n_rows", "skew",
                                                (F.col("host") != "").alias("has_host"))


@query("rebase_ids", """
WITH base AS (SELECT s_nationkey AS c_nationkey,
                     max(TRY_CAST(nullif(regexp_extract(s_name, '(\\d+)$', 1), '') AS BIGINT)) AS b
              FROM supplier GROUP BY 1)
SELECT c_custkey, c_nationkey,
       CAST(coalesce(b, 0) + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS new_id
FROM customer LEFT JOIN base USING (c_nationkey)
""")
def q_rebase_ids(spark, sf_dir):
    """Customers join their nation's member list after its suppliers: ids
    continue after the largest supplier number of the nation."""
    sup = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), "s_name")
    cust = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return rel.rebase_ids(cust, sup, "c_nationkey", "s_name", ["c_custkey"]).select("c_custkey", "c_nationkey", "new_id")


@query("latest_by", """
SELECT user_id, event_id, ts, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
""")
def q_latest_by(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    return rel.latest_by(ev, "user_id", ["ts", "event_id"], ["event_id", "ts", "event_type"])


@query("head", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 2
""")
def q_head(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rel.head(o, 2, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query("distinct_members", """
SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id FROM events
""")
def q_distinct_members(spark, sf_dir):
    return rel.distinct_members(load(spark, sf_dir, "events"), "user_id")


@query("append_rows", """
SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation
""")
def q_append_rows(spark, sf_dir):
    r = load(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    n = load(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    return rel.append_rows(r, n)


HOST_LINE_SQL = """
SELECT 'node' || CAST(p_partkey AS VARCHAR) || ' ' ||
       CASE WHEN p_size > 45 THEN 'many' ELSE CAST(p_size - 5 AS VARCHAR) END AS line FROM part
"""


@query("expand_slots", f"""
WITH l AS ({HOST_LINE_SQL}),
h AS (SELECT split_part(line, ' ', 1) AS host, TRY_CAST(split_part(line, ' ', 2) AS INTEGER) AS n FROM l)
SELECT host, CAST(unnest(range(1, n + 1)) AS INTEGER) AS slot FROM h WHERE n >= 1
""")
def q_expand_slots(spark, sf_dir):
    """A host file made from parts (slots = size - 5, 'many' when large):
    one row per slot; zero, negative and non-numeric counts give none."""
    p = load(spark, sf_dir, "part")
    line = F.concat(F.lit("node"), F.col("p_partkey").cast("string"), F.lit(" "),
                    F.when(F.col("p_size") > 45, F.lit("many")).otherwise((F.col("p_size") - 5).cast("string")))
    parsed = p.select(*[c.alias(n) for n, c in rel.parse_host_line(line).items()])
    return rel.expand_slots(parsed, "host", "slots").select("host", "slot")


@query("expand_ranges", """
SELECT n_nationkey, 'n' || lpad(CAST(x AS VARCHAR), 2, '0') AS host
FROM nation, unnest(range(n_nationkey, n_nationkey + n_regionkey + 1)) AS u(x)
UNION SELECT n_nationkey, 'n' || lpad(CAST(n_nationkey + 30 AS VARCHAR), 3, '0') FROM nation
UNION SELECT n_nationkey, 'r' || CAST(n_regionkey AS VARCHAR) FROM nation
""")
def q_expand_ranges(spark, sf_dir):
    """Compressed host lists made from nation keys, e.g. ``n[03-04,033],r1``."""
    n = load(spark, sf_dir, "nation")
    expr = F.concat(F.lit("n["), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit("-"),
                    F.lpad((F.col("n_nationkey") + F.col("n_regionkey")).cast("string"), 2, "0"), F.lit(","),
                    F.lpad((F.col("n_nationkey") + 30).cast("string"), 3, "0"), F.lit("],r"),
                    F.col("n_regionkey").cast("string"))
    return rel.expand_ranges(n.select("n_nationkey", expr.alias("expr")), "expr").select("n_nationkey", "host")


@query("expand_ranges_product", """
SELECT s_suppkey, 'rack' || lpad(CAST(a AS VARCHAR), 2, '0') || 'u' || CAST(b AS VARCHAR) || '-' || CAST(c AS VARCHAR) AS host
FROM supplier, unnest(range(1, 2 + s_nationkey % 3)) AS t(a), unnest(range(s_suppkey % 7, s_suppkey % 7 + 3)) AS u(b),
     unnest([1, 5]) AS v(c)
""")
def q_expand_ranges_product(spark, sf_dir):
    """Lists with three groups in one item, e.g. ``rack[01-03]u[4-6]-[1,5]``."""
    s = load(spark, sf_dir, "supplier")
    text = lambda c: c.cast("string")
    low = F.col("s_suppkey") % 7
    expr = F.concat(F.lit("rack[01-"), F.lpad(text(F.col("s_nationkey") % 3 + 1), 2, "0"), F.lit("]u["), text(low),
                    F.lit("-"), text(low + 2), F.lit("]-[1,5]"))
    return rel.expand_ranges(s.select("s_suppkey", expr.alias("expr")), "expr").select("s_suppkey", "host")


@query("expand_rejects", """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'not a count' WHEN p_partkey % 5 = 1 THEN 'too many' ELSE 'kept' END AS slots,
       CASE WHEN p_partkey % 5 < 2 THEN 0 ELSE p_size END::BIGINT AS n_slots,
       CASE WHEN p_partkey % 3 = 0 THEN 'no member' WHEN p_partkey % 3 = 1 THEN 'too many' ELSE 'kept' END AS hosts,
       CASE WHEN p_partkey % 3 = 2 THEN 2 * p_size ELSE 0 END::BIGINT AS n_hosts
FROM part
""")
def q_expand_rejects(spark, sf_dir):
    """Slot counts and host lists that can't be expanded come out with a reason: with the
    kept ones every part is there."""
    size, k = F.col("p_size").cast("string"), F.col("p_partkey")
    slots = F.when(k % 5 == 0, F.concat(F.lit("x"), size)).when(k % 5 == 1, F.concat(size, F.lit("0000000000"))).otherwise(size)
    hosts = (F.when(k % 3 == 0, F.lit("n[2-1]m[1-3]")).when(k % 3 == 1, F.lit("n[1-65536]m[1-65536]"))
             .otherwise(F.concat(F.lit("n[1-"), size, F.lit("]m[7,08]"))))
    parts = load(spark, sf_dir, "part").select("p_partkey", slots.alias("slots"), hosts.alias("hosts"))

    def told(kept, rejected, name):
        kept = kept.groupBy("p_partkey").agg(F.lit("kept").alias(name), F.count("*").alias(f"n_{name}"))
        return kept.unionByName(rejected.select("p_partkey", F.col("reason").alias(name), F.lit(0).cast("bigint").alias(f"n_{name}")))

    by_slot = told(*rel.expand_slots_split(parts.select("p_partkey", "slots"), "p_partkey", "slots"), "slots")
    by_host = told(*rel.expand_ranges_split(parts.select("p_partkey", "hosts"), "hosts"), "hosts")
    return by_slot.join(by_host, "p_partkey")


@query("lookup_chain", """
WITH e AS (SELECT event_id, user_id, event_type, ts,
                  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events)
SELECT event_id, first_value(event_type) OVER w AS endpoint, first_value(event_id) OVER w AS root,
       CAST(r - 1 AS BIGINT) AS hops
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
""")
def q_lookup_chain(spark, sf_dir):
    """Each event extends the one before of its user: all stand on the first one."""
    ev = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))  # input of the lookup only
    return rel.lookup_chain(ev.withColumn("parent", before), "event_id", "parent", "event_type").select(
        "event_id", "endpoint", "root", "hops")


_CHAIN_PARENT = "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE (c_custkey * 7 + 3) % (m + 20) END"


@query("lookup_chain_cycles", f"""
WITH RECURSIVE c AS (SELECT c_custkey, c_name, {_CHAIN_PARENT} AS parent
                     FROM customer, (SELECT max(c_custkey) AS m FROM customer)),
known AS (SELECT c_custkey, c_name, CASE WHEN parent IN (SELECT c_custkey FROM c) THEN parent END AS parent FROM c),
walk AS (SELECT c_custkey, c_custkey AS at FROM known
         UNION SELECT w.c_custkey, k.parent FROM walk w JOIN known k ON w.at = k.c_custkey WHERE k.parent IS NOT NULL),
ends AS (SELECT w.c_custkey, max(CASE WHEN k.parent IS NULL THEN w.at END) AS root, count(*) - 1 AS steps
         FROM walk w JOIN known k ON w.at = k.c_custkey GROUP BY w.c_custkey)
SELECT e.c_custkey, r.c_name AS endpoint, e.root, CASE WHEN e.root IS NOT NULL THEN steps END AS hops, e.root IS NULL AS cycle
FROM ends e LEFT JOIN c r ON e.root = r.c_custkey
""")
def q_lookup_chain_cycles(spark, sf_dir):
    """Customers that name any other as parent: chains, unknown parents and cycles."""
    cust = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    m = cust.agg(F.max("c_custkey").alias("m"))
    named = cust.withColumn("m", m.scalar()).withColumn("parent", F.expr(_CHAIN_PARENT)).drop("m")
    return rel.lookup_chain(named, "c_custkey", "parent", "c_name").select("c_custkey", "endpoint", "root", "hops", "cycle")
