"""Queries for column functions: status text, URLs, patterns, JSON, formats,
names (operators 29, 43-48) and the SQL / UDF surface (49, 50)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from shardline.functions import scalars as sc
from shardline.functions.udf import apply_batches, run_sql, vectorized
from shardline.plans.catalog import query
from shardline.sources.tables import load

# A queue listing per order: the code comes from the order status (and the
# priority for variety); the layout varies with the priority: no header,
# no trailing newline (so the second-last piece is the header), or both.
STATUS_HEADER = "JOBID PARTITION NAME USER ST TIME NODES NODELIST(REASON)"


def _status_text():
    code = (F.when(F.col("o_orderpriority") == "5-LOW", F.lit("S"))
            .when(F.col("o_orderstatus") == "F",
                  F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("CF"))
                   .when(F.col("o_orderpriority") == "2-HIGH", F.lit("cg")).otherwise(F.lit("CD")))
            .when(F.col("o_orderstatus") == "O", F.lit("r"))
            .when(F.col("o_orderstatus") == "P", F.lit("PD")))
    line = F.concat(F.lit("   "), F.col("o_orderkey").cast("string"), F.lit(" batch job"),
                    F.col("o_custkey").cast("string"), F.lit(" user "), code, F.lit(" 0:01 1 node1"))
    head = F.lit(STATUS_HEADER + "\n")
    return (F.when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(line, F.lit("\n")))
             .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(head, line))
             .otherwise(F.concat(head, line, F.lit("\n"))))


STATUS_TEXT_SQL = f"""
SELECT o_orderkey,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN l || chr(10)
       WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '{STATUS_HEADER}' || chr(10) || l
       ELSE '{STATUS_HEADER}' || chr(10) || l || chr(10) END AS txt
FROM (SELECT o_orderkey, o_orderpriority, '   ' || CAST(o_orderkey AS VARCHAR) || ' batch job' || CAST(o_custkey AS VARCHAR)
             || ' user ' ||
             CASE WHEN o_orderpriority = '5-LOW' THEN 'S'
                  WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'CF'
                                                     WHEN o_orderpriority = '2-HIGH' THEN 'cg' ELSE 'CD' END
                  WHEN o_orderstatus = 'O' THEN 'r' WHEN o_orderstatus = 'P' THEN 'PD' END
             || ' 0:01 1 node1' AS l FROM orders)
"""


@query("normalize_status", f"""
WITH t AS ({STATUS_TEXT_SQL}),
c AS (SELECT o_orderkey, upper(regexp_split_to_array(regexp_replace(string_split(txt, chr(10))[-2], '^\\s+', ''), '\\s+')[5]) AS code FROM t)
SELECT o_orderkey, CASE WHEN code = 'R' THEN 'Running' WHEN code IN ('CD', 'CF', 'CG') THEN 'Done'
                        WHEN code = 'PD' THEN 'Queue' ELSE 'Unknown' END AS state
FROM c
""")
def q_normalize_status(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    t = o.select("o_orderkey", _status_text().alias("txt"))
    return t.select("o_orderkey", sc.normalize_status("txt").alias("state"))


# by string positions, so that a mistake in the patterns would show
URL_SQL = """
WITH a AS (SELECT page_id, url, strpos(url, '://') AS p FROM pages),
b AS (SELECT page_id, CASE WHEN p > 1 THEN lower(substr(url, 1, p - 1)) END AS scheme,
             CASE WHEN p > 1 THEN split_part(split_part(split_part(substr(url, p + 3), '/', 1), '?', 1), '#', 1) END AS auth
      FROM a)
SELECT page_id, scheme, nullif(lower(split_part(list_last(string_split(auth, '@')), ':', 1)), '') AS host,
       CASE WHEN contains(auth, '@') THEN nullif(split_part(split_part(auth, '@', 1), ':', 1), '') END AS "user"
FROM b
"""


@query("parse_endpoints", URL_SQL)
def q_parse_endpoints(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select("page_id", "url")
    return p.select("page_id", *[c.alias(n) for n, c in sc.parse_endpoints("url").items()])


def _between_sql(start: str, end: str) -> str:
    return (f"CASE WHEN strpos(html, '{start}') > 0 AND strpos(substr(html, strpos(html, '{start}')), '{end}') > 0 "
            f"THEN split_part(substr(html, strpos(html, '{start}') + length('{start}')), '{end}', 1) END")


@query("extract_pattern", f"""
SELECT page_id, {_between_sql('<title>', '</title>')} AS title, {_between_sql('<html lang="', '"')} AS lang FROM pages
""")
def q_extract_pattern(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select("page_id", "html")
    return p.select("page_id", sc.extract_pattern("html", r"<title>(.*?)</title>").alias("title"),
                    sc.extract_pattern("html", r'<html lang="([^"]*)"').alias("lang"))


@query("json_path", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
""")
def q_json_path(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select("event_id", "props")
    return ev.select("event_id", sc.json_path("props", "$.k").cast("bigint").alias("k"))


@query("format_duration", """
SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS minutes,
       CAST(CAST(floor(p_retailprice) AS BIGINT) // 60 AS VARCHAR) || ':' ||
       CAST(CAST(floor(p_retailprice) AS BIGINT) % 60 AS VARCHAR) || ':00' AS walltime
FROM part
""")
def q_format_duration(spark, sf_dir):
    """A wall time in minutes (the part's price, floored) as ``H:M:00``."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.floor("p_retailprice").cast("bigint").alias("minutes"))
    return p.select("p_partkey", "minutes", sc.format_duration("minutes").alias("walltime"))


@query("format_duration_size", """
SELECT p_partkey, p_size AS minutes,
       CAST(p_size // 60 AS VARCHAR) || ':' || CAST(p_size % 60 AS VARCHAR) || ':00' AS walltime
FROM part
""")
def q_format_duration_size(spark, sf_dir):
    """The part size read as minutes (all under an hour: ``0:M:00``)."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("minutes"))
    return p.select("p_partkey", "minutes", sc.format_duration("minutes").alias("walltime"))


@query("format_timestamp", """
SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS stamp, strftime(ts, '%Y%m%d_%H%M%S') AS stamp_underscore FROM events
""")
def q_format_timestamp(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select("event_id", "ts")
    return ev.select("event_id", sc.format_timestamp("ts").alias("stamp"),
                     sc.format_timestamp("ts", sc.RUN_STAMP_UNDERSCORE).alias("stamp_underscore"))


@query("build_name", """
SELECT c_custkey, concat_ws('-', c_mktsegment, 'spark', right(c_name, 5)) AS name,
       'ps-' || left(c_name, 5) AS short_name
FROM customer
""")
def q_build_name(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    return c.select("c_custkey",
                    sc.build_name(["c_mktsegment", F.lit("spark"), sc.tail_chars("c_name", 5)]).alias("name"),
                    F.concat(F.lit("ps-"), sc.head_chars("c_name", 5)).alias("short_name"))


RUN_SQL = """
SELECT l_returnflag, l_linestatus,
       round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       count(*) AS count_order
FROM {lineitem}
WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
GROUP BY l_returnflag, l_linestatus
"""


@query("run_sql", RUN_SQL.format(lineitem="lineitem"))
def q_run_sql(spark, sf_dir):
    """SQL over the handed-out session: a pricing summary over line items."""
    return run_sql(spark, {"lineitem": load(spark, sf_dir, "lineitem")}, RUN_SQL)


RUN_SQL_JOIN = """
SELECT c_mktsegment, o_orderpriority,
       count(DISTINCT o_orderkey) AS n_orders,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM {customer} JOIN {orders} ON c_custkey = o_custkey
              JOIN {lineitem} ON l_orderkey = o_orderkey
WHERE l_returnflag <> 'R'
GROUP BY c_mktsegment, o_orderpriority
"""


@query("run_sql_join", RUN_SQL_JOIN.format(customer="customer", orders="orders", lineitem="lineitem"))
def q_run_sql_join(spark, sf_dir):
    """SQL over three bound frames: revenue by market segment and order
    priority (Catalyst plans the joins; AQE picks broadcast or shuffle)."""
    frames = {t: load(spark, sf_dir, t) for t in ("customer", "orders", "lineitem")}
    return run_sql(spark, frames, RUN_SQL_JOIN)


RUN_SQL_BOUND = "SELECT l_returnflag, count(*) AS n, :label AS label FROM {lines} WHERE l_quantity > :least GROUP BY l_returnflag"


@query("run_sql_bound", """
SELECT l_returnflag, count(*) AS n, 'small' AS label FROM lineitem WHERE l_linenumber < 3 AND l_quantity > 10 GROUP BY l_returnflag
UNION ALL
SELECT l_returnflag, count(*) AS n, 'it''s {large}' AS label FROM lineitem WHERE l_linenumber >= 3 AND l_quantity > 30
GROUP BY l_returnflag
""")
def q_run_sql_bound(spark, sf_dir):
    """Two calls with one frame name and one statement, each with frame and values of its own."""
    li = load(spark, sf_dir, "lineitem")
    one = run_sql(spark, {"lines": li.filter("l_linenumber < 3")}, RUN_SQL_BOUND, {"least": 10, "label": "small"})
    two = run_sql(spark, {"lines": li.filter("l_linenumber >= 3")}, RUN_SQL_BOUND, {"least": 30, "label": "it's {large}"})
    return one.unionByName(two)


def _square(s: pd.Series) -> pd.Series:
    return s.astype("int64") * s.astype("int64")


@query("apply_function", """
SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) * l_linenumber AS sq FROM lineitem
""")
def q_apply_function(spark, sf_dir):
    """A user's Python function (square) as a vectorized Pandas UDF."""
    square = vectorized(_square, "bigint")
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return li.select("l_orderkey", "l_linenumber", square("l_linenumber").alias("sq"))


def _payload_len(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"conv_id": pdf["conv_id"], "turn": pdf["turn"],
                         "n_bytes": pdf["text"].map(lambda t: len(t.encode("utf-8")) if t is not None else None)})


@query("apply_function_batches", """
SELECT conv_id, turn, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM conversations
""")
def q_apply_function_batches(spark, sf_dir):
    """A user's function of a pandas DataFrame over every Arrow batch."""
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return apply_batches(c, _payload_len, "conv_id long, turn long, n_bytes long")
