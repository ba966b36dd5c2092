"""Column expressions for payloads, status text, URLs, patterns, JSON and formats.

All of them are built-in Spark expressions (JVM side, whole-stage codegen);
none needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- payloads ---------------------------------------------------------------

def encode_payload(text) -> Column:
    """UTF-8 text -> base64 string (as a producer does before sending)."""
    return F.base64(F.encode(_c(text), "UTF-8"))


def decode_payload(data) -> Column:
    """base64 record data -> UTF-8 text (line breaks inside the base64 are accepted);
    null when the data is no base64 or no UTF-8 (see ``bad_payload``)."""
    data = F.regexp_replace(_c(data), r"[\r\n]", "")
    return F.try_validate_utf8(F.try_to_binary(data, F.lit("base64")).cast("string"))


def bad_payload(data) -> Column:
    """True for record data that is there but can't be decoded."""
    return _c(data).isNotNull() & decode_payload(data).isNull()


# -- job status ---------------------------------------------------------------

# Queue status codes and the states they mean.
STATUS_CODES = {"R": "Running", "CD": "Done", "CF": "Done", "CG": "Done", "PD": "Queue"}
UNKNOWN_STATE = "Unknown"


def status_code(text) -> Column:
    """The 5th blank-separated token of the second-last newline-separated
    piece of a queue listing (null when there is no such token)."""
    pieces = F.split(_c(text), "\n")
    line = F.try_element_at(pieces, F.lit(-2))
    tokens = F.split(F.regexp_replace(line, r"^\s+", ""), r"\s+")
    return F.try_element_at(tokens, F.lit(5))


def normalize_status(text) -> Column:
    """Map the status code of a queue listing to Running / Done / Queue / Unknown."""
    code = F.upper(status_code(text))
    expr = None
    for k, v in STATUS_CODES.items():
        expr = (F.when(code == k, v) if expr is None else expr.when(code == k, v))
    return expr.otherwise(UNKNOWN_STATE)


# -- URLs -------------------------------------------------------------------

def url_scheme(url) -> Column:
    return F.nullif(F.lower(F.regexp_extract(_c(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit(""))


def url_host(url) -> Column:
    """Host name (lower case, no user, no port), null when absent."""
    authority = F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    # the user ends at the last @; an IPv6 address stands in brackets and keeps its colons
    host = F.regexp_extract(authority, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1)
    return F.nullif(F.lower(host), F.lit(""))


def url_user(url) -> Column:
    """User name of ``scheme://user[:password]@host``; null when absent."""
    authority = F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.nullif(F.regexp_extract(authority, r"^([^@:]*)(?::[^@]*)?@", 1), F.lit(""))


def url_query(url) -> Column:
    """Query string (between ``?`` and ``#``), empty string when absent."""
    return F.regexp_extract(_c(url), r"\?([^#]*)", 1)


def parse_endpoints(url) -> dict[str, Column]:
    """scheme, host, user of a URL as named columns."""
    return {"scheme": url_scheme(url), "host": url_host(url), "user": url_user(url)}


# -- patterns and JSON ------------------------------------------------------

def extract_pattern(text, regex: str, group: int = 1) -> Column:
    """First match of ``regex`` (its ``group``, which may be empty); null when
    nothing matches."""
    return F.when(_c(text).rlike(regex), F.regexp_extract(_c(text), regex, group))


def json_path(text, path: str) -> Column:
    """One field of a JSON document by path (``$.a.b``), as a string."""
    return F.get_json_object(_c(text), path)


# -- formats ----------------------------------------------------------------

def format_duration(minutes) -> Column:
    """Minutes -> ``H:M:00`` with floor and remainder and no zero padding
    (59 -> ``0:59:00``, 61 -> ``1:1:00``)."""
    m = _c(minutes).cast("bigint")
    rest = F.pmod(m, F.lit(60)).cast("bigint")
    hours = F.call_function("div", m - rest, F.lit(60).cast("bigint"))
    return F.concat(hours.cast("string"), F.lit(":"), rest.cast("string"), F.lit(":00"))


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 00:00 of a ``timestamp_ntz`` wall-clock
    time, independent of the session time zone (read as UTC; exact also for
    times that fall into a daylight-saving gap of the session zone)."""
    c = _c(ts)
    return F.unix_micros(F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c),
                                          F.date_part(F.lit("SECOND"), c), F.lit("UTC")))


# Run-stamp layouts.
RUN_STAMP = "yyyyMMdd-HHmmss"
RUN_STAMP_UNDERSCORE = "yyyyMMdd_HHmmss"


def format_timestamp(ts, layout: str = RUN_STAMP) -> Column:
    return F.date_format(_c(ts), layout)


def build_name(parts, sep: str = "-") -> Column:
    """Join fields with ``sep`` (nulls are skipped)."""
    return F.concat_ws(sep, *[_c(p) for p in parts])


def head_chars(s, n: int) -> Column:
    return F.left(_c(s), F.lit(int(n)))


def tail_chars(s, n: int) -> Column:
    return F.right(_c(s), F.lit(int(n)))
