"""Text-shaped inputs: JSON records, ``key=value`` pairs, performance traces.

Each reader has a column form (parse a string column of any DataFrame) and a
file form (``spark.read.text``/``json`` over many files, one row per line,
with the file name from ``_metadata``). Parsing is built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- 4: JSON ------------------------------------------------------------------

def parse_json(col, schema: str | T.StructType) -> Column:
    """Typed struct out of a JSON string column (unknown fields ignored,
    missing ones null)."""
    return F.from_json(_c(col), schema)


def read_json_records(spark: SparkSession, paths, schema: str | T.StructType, multi_line: bool = False,
                      corrupt: str | None = None) -> DataFrame:
    """JSON records with a declared schema (no inference pass over the data):
    one object per line, or with ``multi_line`` one (pretty-printed) document
    per file, as description files are written. A line that is no JSON object, or
    has a field of another type, keeps the fields that can be read, the others are null;
    ``corrupt`` names a string column that gets such a line as it is, null for all others."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    reader = spark.read.option("multiLine", multi_line)
    if corrupt:
        kind = T.StructType([*kind.fields, T.StructField(corrupt, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    return reader.schema(kind).json(paths)


#: Kinds of a variant, by the word its type begins with.
_KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def parse_open_json(df: DataFrame, col, record: str = "record", corrupt: str = "corrupt") -> DataFrame:
    """JSON text without a declared schema: ``record`` is a VARIANT that keeps every field
    whatever its type, null where the text doesn't begin with a JSON value; such a text is in
    ``corrupt``. What follows a whole value is ignored."""
    text = _c(col)
    return df.withColumn(record, F.try_parse_json(text)).withColumn(
        corrupt, F.when(text.isNotNull() & F.col(record).isNull(), text))


def variant_kind(record) -> Column:
    """``object``, ``array``, ``string``, ``number``, ``boolean`` or ``null`` (JSON's own);
    null without a record."""
    word = F.regexp_extract(F.schema_of_variant(_c(record)), "^[A-Z]+", 0)
    kind = None
    for name, k in _KINDS.items():
        kind = F.when(word == name, k) if kind is None else kind.when(word == name, k)
    return F.when(_c(record).isNotNull(), kind.otherwise("number"))


def open_field(record, path: str, kind: str) -> Column:
    """A field of a variant by path (``$.a.b[0]``) as ``kind``; null where it is missing or
    can't be read so."""
    return F.try_variant_get(_c(record), path, kind)


def schema_of_records(df: DataFrame, record: str = "record") -> DataFrame:
    """One row: the ``schema`` that all records fit (partial aggregation)."""
    return df.agg(F.schema_of_variant_agg(record).alias("schema"))


# -- 5: key=value -------------------------------------------------------------

def split_pairs(df: DataFrame, col, sep: str = "&", prefixes: list[str] | None = None,
                keep: list[str] | None = None) -> DataFrame:
    """One row per ``key=value`` pair of a string column. The value is all
    text after the first ``=`` (a second ``=`` stays in the value); a pair
    without ``=`` has a null value; empty pairs are skipped. With
    ``prefixes``, keep keys starting with any of them (a literal prefix
    match: ``zookeeper.connect`` also keeps ``zookeeper.connection.timeout.ms``)."""
    keep = keep or []
    pairs = df.select(*keep, F.explode(F.split(_c(col), _regex_literal(sep))).alias("_sl_pair"))
    pairs = pairs.filter(F.col("_sl_pair") != "")
    kv = F.split(F.col("_sl_pair"), "=", 2)
    out = pairs.select(*keep, F.trim(kv[0]).alias("key"), F.trim(F.try_element_at(kv, F.lit(2))).alias("value"))
    return _filter_prefixes(out, prefixes)


def _regex_literal(s: str) -> str:
    import re
    return re.escape(s)


def _filter_prefixes(df: DataFrame, prefixes: list[str] | None) -> DataFrame:
    if not prefixes:
        return df
    cond = None
    for p in prefixes:
        c = F.col("key").startswith(p)
        cond = c if cond is None else (cond | c)
    return df.filter(cond)


def scan_properties(spark: SparkSession, paths, prefixes: list[str] | None = None) -> DataFrame:
    """``key=value`` configuration files: one row per (file, key, value);
    ``#`` comments and blank lines skipped; several files never overwrite
    each other's keys."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    body = lines.filter(~F.regexp_like(F.col("line"), F.lit(r"^\s*(#.*)?$")))
    kv = F.split(F.col("line"), "=", 2)
    out = body.select("file", F.trim(kv[0]).alias("key"), F.trim(F.try_element_at(kv, F.lit(2))).alias("value"))
    return _filter_prefixes(out, prefixes)


def scan_config(spark: SparkSession, paths, style: str = "properties",
                prefixes: list[str] | None = None) -> DataFrame:
    """Configuration files as ``(file, key, value)`` rows, in three shapes:
    ``properties`` (``key=value``), ``yaml`` (flat ``key: value``) and
    ``xml`` (``<property><name>..</name><value>..</value></property>``).
    Line formats are read line by line over all files in parallel; XML by Spark's own
    source, one row per ``property`` element wherever it begins, so that a large file is
    split like any other and comments, entities and CDATA mean what they should. Pairs
    without a key are left out."""
    if style == "properties":
        return scan_properties(spark, paths, prefixes)
    if style == "yaml":
        lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
        body = lines.filter(~F.regexp_like(F.col("line"), F.lit(r"^\s*(#.*)?$")))
        kv = F.split(F.col("line"), r":\s", 2)
        out = body.filter(F.size(kv) == 2).select("file", F.trim(kv[0]).alias("key"), F.trim(kv[1]).alias("value"))
        return _filter_prefixes(out, prefixes)
    if style == "xml":
        props = spark.read.option("rowTag", "property").schema("name string, value string").xml(paths)
        out = props.select(F.col("_metadata.file_path").alias("file"), F.trim("name").alias("key"),
                           F.trim("value").alias("value"))
        return _filter_prefixes(out.filter(F.col("key") != ""), prefixes)
    raise ValueError(f"unknown config style {style!r}")


# -- 6: traces ----------------------------------------------------------------

TRACE_SCHEMA = "phase string, framework string, nodes int, seconds double"


def parse_trace(line) -> dict[str, Column]:
    """Both trace layouts into one schema: ``phase, nodes, seconds`` and
    ``phase,framework, nodes, seconds`` (blanks after commas optional).
    Lines of any other width give nulls."""
    parts = F.split(F.trim(_c(line)), r",\s*")
    n = F.size(parts)
    four = n == 4
    three = n == 3
    return {
        "phase": F.when(three | four, parts[0]),
        "framework": F.when(four, parts[1]),
        "nodes": F.when(four, parts[2]).when(three, parts[1]).try_cast("int"),
        "seconds": F.when(four, parts[3]).when(three, parts[2]).try_cast("double"),
    }


def scan_traces(spark: SparkSession, paths) -> DataFrame:
    """Trace files (CSV without header, either layout, mixed)."""
    lines = spark.read.text(paths)
    return lines.select(*[c.alias(n) for n, c in parse_trace("value").items()])
