"""Queries for sources and sinks: parallelize, JSON, key=value pairs,
traces, trace appends, gather (operators 1, 4-6, 8, 9, 35)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardline.operators.relational import route, trace_summary, write_routes
from shardline.plans.catalog import query
from shardline.session import shared_path
from shardline.sources import sinks
from shardline.sources.parallel import parallelize
from shardline.sources.tables import load
from shardline.sources.text_inputs import (open_field, parse_json, parse_open_json, parse_trace, read_json_records,
                                           scan_config, scan_traces, split_pairs, variant_kind)


@query("parallelize", """
SELECT range AS value, range * range AS sq, o_custkey
FROM range((SELECT count(*) FROM orders)) LEFT JOIN orders ON range = o_orderkey
""")
def q_parallelize(spark, sf_dir):
    """A distributed range as long as the orders table, squared (the distributed map of the
    getting-started example), with the customer of the order of that number."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    values = parallelize(spark, orders.count())
    return values.join(orders, F.col("value") == F.col("o_orderkey"), "left").select(
        "value", (F.col("value") * F.col("value")).alias("sq"), "o_custkey")


@query("read_json_records", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events
""")
def q_read_json_records(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select("event_id", "props")
    return ev.select("event_id", parse_json("props", "k int").alias("p")).select("event_id", "p.k")


@query("scan_key_values", """
WITH q AS (SELECT page_id, regexp_extract(url, '\\?([^#]*)', 1) AS qs FROM pages),
p AS (SELECT page_id, unnest(string_split(qs, '&')) AS pair FROM q)
SELECT page_id, trim(split_part(pair, '=', 1)) AS key,
       CASE WHEN strpos(pair, '=') > 0 THEN trim(substr(pair, strpos(pair, '=') + 1)) END AS value
FROM p WHERE pair <> '' AND (starts_with(trim(split_part(pair, '=', 1)), 'page')
                             OR starts_with(trim(split_part(pair, '=', 1)), 'utm_'))
""")
def q_scan_key_values(spark, sf_dir):
    """Query strings of page URLs as key=value pairs, keys starting with
    ``page`` or ``utm_``."""
    from shardline.functions.scalars import url_query
    p = load(spark, sf_dir, "pages").select("page_id", url_query("url").alias("qs"))
    return split_pairs(p, "qs", "&", prefixes=["page", "utm_"], keep=["page_id"])


TRACE_LINE_SQL = """
SELECT event_id AS line_id,
       CASE WHEN event_id % 2 = 0
            THEN event_type || ', ' || CAST(user_id AS VARCHAR) || ', ' || CAST(event_id AS VARCHAR)
            ELSE event_type || ',spark, ' || CAST(user_id AS VARCHAR) || ', ' || CAST(event_id AS VARCHAR) END AS line
FROM events
"""
TRACE_PARSED_SQL = f"""
SELECT line_id, parts[1] AS phase, CASE WHEN len(parts) = 4 THEN parts[2] END AS framework,
       CAST(CASE WHEN len(parts) = 4 THEN parts[3] ELSE parts[2] END AS INTEGER) AS nodes,
       CAST(CASE WHEN len(parts) = 4 THEN parts[4] ELSE parts[3] END AS DOUBLE) AS seconds
FROM (SELECT line_id, regexp_split_to_array(line, ',\\s*') AS parts FROM ({TRACE_LINE_SQL}))
"""


def _trace_lines(spark, sf_dir):
    """Trace lines from events, half in each layout (3 fields: phase, nodes,
    seconds; 4 fields with the framework), all numbers integers."""
    ev = load(spark, sf_dir, "events")
    three = F.concat_ws(", ", "event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    four = F.concat(F.col("event_type"), F.lit(",spark, "), F.col("user_id").cast("string"), F.lit(", "),
                    F.col("event_id").cast("string"))
    return ev.select(F.col("event_id").alias("line_id"),
                     F.when(F.col("event_id") % 2 == 0, three).otherwise(four).alias("line"))


def _parsed_traces(spark, sf_dir):
    lines = _trace_lines(spark, sf_dir)
    return lines.select("line_id", *[c.alias(n) for n, c in parse_trace("line").items()])


@query("scan_traces", TRACE_PARSED_SQL)
def q_scan_traces(spark, sf_dir):
    return _parsed_traces(spark, sf_dir)


@query("trace_summary", f"""
SELECT phase, framework, nodes, count(*) AS n, min(seconds) AS min_seconds,
       avg(seconds) AS avg_seconds, max(seconds) AS max_seconds
FROM ({TRACE_PARSED_SQL}) GROUP BY phase, framework, nodes
""")
def q_trace_summary(spark, sf_dir):
    return trace_summary(_parsed_traces(spark, sf_dir))


@query("append_traces", f"""
SELECT phase, framework, nodes, seconds FROM ({TRACE_PARSED_SQL})
""")
def q_append_traces(spark, sf_dir):
    """Two appends (three-field rows, then four-field rows) to one trace
    folder in the shared checkpoint area, read back."""
    parsed = _parsed_traces(spark, sf_dir)
    path = shared_path(spark, "traces")
    sinks.append_traces(parsed.filter(F.col("framework").isNull()), path)
    sinks.append_traces(parsed.filter(F.col("framework").isNotNull()), path)
    return sinks.read_traces(spark, path)


@query("gather", """
SELECT DISTINCT CAST(l_linenumber * l_linenumber AS BIGINT) AS sq FROM lineitem
""")
def q_gather(spark, sf_dir):
    """A small result (the squares of the line numbers) brought back whole to the
    caller; more than 100 rows would be refused."""
    li = load(spark, sf_dir, "lineitem")
    sq = li.select((F.col("l_linenumber") * F.col("l_linenumber")).cast("bigint").alias("sq")).distinct()
    rows = sinks.gather(sq, 100)
    return spark.createDataFrame(rows, "sq bigint")


# -- file forms: text inputs written and read through the shared folder ------------

@query("read_json_files", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events
""")
def q_read_json_files(spark, sf_dir):
    """Events as JSON lines in a folder, read back by schema."""
    path = shared_path(spark, "json")
    load(spark, sf_dir, "events").select(
        F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "k": '),
                 F.get_json_object("props", "$.k"), F.lit("}"))).write.text(path)
    return read_json_records(spark, path, "event_id long, k int")


@query("scan_trace_files", TRACE_PARSED_SQL.replace("line_id, ", "", 1))
def q_scan_trace_files(spark, sf_dir):
    """The trace lines as text files, both layouts in one folder."""
    path = shared_path(spark, "trace-files")
    _trace_lines(spark, sf_dir).select("line").write.text(path)
    return scan_traces(spark, path).select("phase", "framework", "nodes", "seconds")


@query("write_routes", """
SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN 'secure' WHEN starts_with(url, 'http://') THEN 'plain'
                     ELSE 'unsupported' END AS route
FROM pages
""")
def q_write_routes(spark, sf_dir):
    """Pages routed by URL prefix, each branch in its own folder, read back."""
    path = shared_path(spark, "routes")
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    write_routes(route(pages, "url", [("https://", "secure"), ("http://", "plain")]), path)
    return spark.read.parquet(path).select("page_id", "route")


# Lines of mixed quality made of events: cut off, a text for a number, an array, nested, a
# bare number, JSON null, and as they are.
_OPEN_LINE = """CASE event_id % 7 WHEN 0 THEN '{"k": ' WHEN 1 THEN '{"k": "' || event_type || '"}'
  WHEN 2 THEN '[' || event_id || ', "' || event_type || '"]' WHEN 3 THEN '{"k": {"a": [' || user_id || ', true]}}'
  WHEN 4 THEN CAST(event_id AS VARCHAR(20)) WHEN 5 THEN 'null' ELSE props END"""


def _open_lines(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.expr(_OPEN_LINE).alias("line"))


@query("open_json", f"""
WITH l AS (SELECT event_id, {_OPEN_LINE} AS line FROM events),
j AS (SELECT *, json_valid(line) AS ok, try_cast(line AS JSON) AS j FROM l)
SELECT event_id, CASE WHEN NOT ok THEN line END AS corrupt,
       CASE WHEN ok THEN CASE json_type(j) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null'
                                           ELSE 'number' END END AS kind,
       CASE WHEN ok AND json_type(j, '$.k') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract(j, '$.k') AS BIGINT) END AS k,
       CASE WHEN ok AND json_type(j, '$.k') = 'VARCHAR' THEN json_extract_string(j, '$.k') END AS k_text,
       CASE WHEN ok THEN CAST(json_extract(j, '$.k.a[0]') AS BIGINT) END AS first_a,
       CASE WHEN ok AND json_type(j) = 'ARRAY' THEN json_extract_string(j, '$[1]') END AS second
FROM j
""")
def q_open_json(spark, sf_dir):
    """JSON lines without a schema, some malformed, fields of mixed types, as variants."""
    rows = parse_open_json(_open_lines(spark, sf_dir), "line")
    k = F.expr("try_variant_get(record, '$.k', 'variant')")
    is_text = variant_kind(k) == "string"
    return rows.select("event_id", "corrupt", variant_kind("record").alias("kind"),
                       F.when(variant_kind(k) == "number", open_field("record", "$.k", "bigint")).alias("k"),
                       F.when(is_text, open_field("record", "$.k", "string")).alias("k_text"),
                       open_field("record", "$.k.a[0]", "bigint").alias("first_a"),
                       open_field("record", "$[1]", "string").alias("second"))


@query("json_corrupt_files", f"""
WITH l AS (SELECT event_id, {_OPEN_LINE} AS line FROM events WHERE event_id % 7 IN (0, 1, 3, 6))
SELECT CASE WHEN event_id % 7 = 6 THEN CAST(json_extract(line, '$.k') AS INTEGER) END AS k,
       CASE WHEN event_id % 7 <> 6 THEN line END AS bad, count(*) AS n
FROM l GROUP BY ALL
""")
def q_json_corrupt_files(spark, sf_dir):
    """JSON line files with a declared schema: lines that don't fit it are kept as text."""
    path = shared_path(spark, "json-lines")
    _open_lines(spark, sf_dir).filter("event_id % 7 IN (0, 1, 3, 6)").select("line").write.text(path)
    return read_json_records(spark, path, "k int", corrupt="bad").groupBy("k", "bad").agg(F.count("*").alias("n"))


# -- configuration files written out of events -----------------------------------

def _settings(spark, sf_dir):
    """key, value: values with a second separator and characters that XML must escape."""
    ev = load(spark, sf_dir, "events")
    return ev.select(F.concat_ws(".", F.lit("zookeeper"), "event_type", F.col("event_id").cast("string")).alias("key"),
                     F.concat(F.lit("a=<"), F.col("user_id").cast("string"), F.lit("> & b: "), "event_type").alias("value"))


_SETTINGS_SQL = """
SELECT 'zookeeper.' || event_type || '.' || event_id AS key, 'a=<' || user_id || '> & b: ' || event_type AS value
FROM events WHERE starts_with(event_type, 'p') OR starts_with(event_type, 'c')
"""
_PREFIXES = ["zookeeper.p", "zookeeper.c"]


def _line_files(spark, sf_dir, name, sep):
    path = shared_path(spark, name)
    line = F.concat(F.lit("  "), F.col("key"), F.lit(sep), F.col("value"))
    lines = _settings(spark, sf_dir).select(F.explode(F.array(line, F.lit("# a comment"), F.lit(" "))).alias("line"))
    lines.write.text(path)
    return path


@query("scan_properties_files", _SETTINGS_SQL)
def q_scan_properties_files(spark, sf_dir):
    """``key=value`` files with comments and blank lines; a second ``=`` stays in the value."""
    return scan_config(spark, _line_files(spark, sf_dir, "properties", " = "), "properties", _PREFIXES).select("key", "value")


@query("scan_yaml_files", _SETTINGS_SQL)
def q_scan_yaml_files(spark, sf_dir):
    """Flat YAML files; a second colon stays in the value."""
    return scan_config(spark, _line_files(spark, sf_dir, "yaml", ": "), "yaml", _PREFIXES).select("key", "value")


@query("scan_xml_files", _SETTINGS_SQL)
def q_scan_xml_files(spark, sf_dir):
    """``property`` elements of XML files, with escaped characters."""
    path = shared_path(spark, "xml")
    (_settings(spark, sf_dir).select(F.col("key").alias("name"), "value")
     .write.option("rootTag", "configuration").option("rowTag", "property").xml(path))
    return scan_config(spark, path, "xml", _PREFIXES).select("key", "value")
