"""Compare a registered Spark query with its DuckDB oracle, the way the
driver does: columns by name, row count, order-insensitive values, dtypes.

    python -m tests.oracle_compare [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

from shardline.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if isinstance(v, (pd.Timestamp,)):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return sorted(out, key=lambda r: tuple((x is None, repr(x)) for x in r))


def compare(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame) -> list[str]:
    problems = []
    if sorted(spark_pdf.columns) != sorted(oracle_pdf.columns):
        return [f"columns differ: spark={sorted(spark_pdf.columns)} oracle={sorted(oracle_pdf.columns)}"]
    if len(spark_pdf) != len(oracle_pdf):
        problems.append(f"row count spark={len(spark_pdf)} oracle={len(oracle_pdf)}")
    for c in sorted(spark_pdf.columns):
        a, b = str(spark_pdf[c].dtype), str(oracle_pdf[c].dtype)
        if a != b:
            problems.append(f"dtype {c}: spark={a} oracle={b}")
    ra, rb = rows(spark_pdf), rows(oracle_pdf)
    if ra != rb:
        diff = [(x, y) for x, y in zip(ra, rb) if x != y][:3]
        problems.append(f"values differ, first: {diff}")
    return problems


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    names = []
    for a in argv:
        if a.startswith("/"):
            sf_dir = a
        else:
            names.append(a)
    from shardline.session import build_session
    import __spark_entry__ as entry
    spark = build_session("local[8]")
    if os.environ.get("ORACLE_SHUFFLE_PARTITIONS"):  # e.g. Spark's default of 200
        spark.conf.set("spark.sql.shuffle.partitions", os.environ["ORACLE_SHUFFLE_PARTITIONS"])
    if os.environ.get("ORACLE_SESSION_TZ"):  # check independence of the session time zone
        spark.conf.set("spark.sql.session.timeZone", os.environ["ORACLE_SESSION_TZ"])
    qs, sql = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or sorted(qs):
        t = time.time()
        try:
            sp = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # report and continue
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        dt = time.time() - t
        if name not in sql:
            print(f"ROWS {name}: {len(sp)} rows ({dt:.1f}s, no oracle)")
            continue
        try:
            od = con.execute(sql[name]).df()
        except Exception as e:
            print(f"FAIL {name}: oracle error {e}")
            bad += 1
            continue
        probs = compare(sp, od)
        hard = [p for p in probs if not p.startswith("dtype")]
        status = "FAIL" if hard else ("TYPE" if probs else "OK  ")
        bad += bool(hard)
        print(f"{status} {name}: {len(sp)} rows ({dt:.1f}s) {'; '.join(probs)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
