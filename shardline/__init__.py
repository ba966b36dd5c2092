"""shardline: keyed event streams and the table work around them, as Spark jobs.

Subpackages
-----------
sources    readers and writers (topic log, JSON, key=value text, traces, sinks)
operators  DataFrame operators (topic log, relational, lookups, aggregates, expansion)
functions  column expressions (decode, status, URL, pattern, JSON, formatting) and UDF/SQL surface
streaming  Structured Streaming jobs (handlers, handler swap, reader groups, retention, sessions)
plans      the registered queries over the driver tables and their SQL oracles
"""

from shardline.session import build_session, shared_path

__all__ = ["build_session", "shared_path"]
