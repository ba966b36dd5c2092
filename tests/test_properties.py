"""Property tests: generated inputs, Spark result against a plain Python
statement of each rule. Each example is one list of inputs run as one
Spark job."""

import itertools
import math
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shardline.functions import scalars as sc
from shardline.operators import relational as rel
from shardline.sources.text_inputs import parse_trace, split_pairs

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def py_status(text):
    try:
        code = text.split("\n")[-2].split()[4]
    except (IndexError, AttributeError):
        return "Unknown"
    return {"R": "Running", "CD": "Done", "CF": "Done", "CG": "Done", "PD": "Queue"}.get(code.upper(), "Unknown")


token = st.sampled_from(["R", "r", "CD", "cg", "CF", "PD", "F", "x", "", "  ", "\t", "123", "node1"])
line = st.lists(token, max_size=7).map(lambda ts: " ".join(ts))
text = st.lists(line, max_size=4).map(lambda ls: "\n".join(ls)) | st.lists(line, max_size=3).map(
    lambda ls: "\n".join(ls) + "\n")


@SETTINGS
@given(st.lists(text, min_size=1, max_size=40))
def test_status_rule(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", sc.normalize_status("t").alias("s")).collect()}
    assert got == {i: py_status(t) for i, t in enumerate(texts)}


@SETTINGS
@given(st.lists(st.integers(min_value=-5000, max_value=100000), min_size=1, max_size=40))
def test_duration_rule(spark, minutes):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(minutes)], "i int, m long")
    got = {r.i: r.d for r in df.select("i", sc.format_duration("m").alias("d")).collect()}
    assert got == {i: f"{math.floor(m / 60)}:{m % 60}:00" for i, m in enumerate(minutes)}


def py_members(body):
    out = []
    for part in body.split(","):
        r = re.match(r"^(\d+)(?:-(\d+))?$", part)
        if r:
            lo, hi = int(r.group(1)), int(r.group(2) or r.group(1))
            out += [str(x).zfill(len(r.group(1))) for x in range(lo, hi + 1)]
    return out


def py_expand(expr):
    out = set()
    for item in re.findall(r"(?:[^,\[\]]|\[[^\[\]]*\])+", expr):
        texts = re.split(r"\[([^\[\]]*)\]", item)  # text, body, text, body, ..., text
        sides = [[t] if k % 2 == 0 else py_members(t) for k, t in enumerate(texts)]
        out |= {"".join(x) for x in itertools.product(*sides)}
    return out


num = st.integers(min_value=0, max_value=40).map(str) | st.integers(min_value=0, max_value=40).map(lambda x: f"{x:03d}")
part = st.tuples(num, st.none() | num).map(lambda t: t[0] if t[1] is None else f"{t[0]}-{t[1]}")
small = st.tuples(st.sampled_from(["0", "01", "7", "10"]), st.none() | st.sampled_from(["2", "9", "011"])).map(
    lambda t: t[0] if t[1] is None else f"{t[0]}-{t[1]}")
piece = st.sampled_from(["n", "gpu", "c1-", ""]) | st.lists(small, min_size=1, max_size=3).map(lambda p: f"[{','.join(p)}]")
item = st.tuples(st.sampled_from(["n", "gpu", "c1-", ""]), st.none() | st.lists(part, min_size=1, max_size=3)).map(
    lambda t: t[0] if t[1] is None else f"{t[0]}[{','.join(t[1])}]") | st.lists(piece, min_size=1, max_size=4).map("".join)
expr = st.lists(item, min_size=1, max_size=3).map(",".join)


@SETTINGS
@given(st.lists(expr, min_size=1, max_size=15))
def test_expand_ranges_rule(spark, exprs):
    df = spark.createDataFrame([(i, e) for i, e in enumerate(exprs)], "i int, e string")
    got = {}
    for r in rel.expand_ranges(df, "e", chunk=7).collect():
        got.setdefault(r.i, set()).add(r.host)
    want = {i: py_expand(e) for i, e in enumerate(exprs)}
    assert got == {i: s for i, s in want.items() if s}
    # every item has members or is rejected
    items = [(i, x) for i, e in enumerate(exprs) for x in re.findall(r"(?:[^,\[\]]|\[[^\[\]]*\])+", e)]
    rejected = sorted((r.i, r.item) for r in rel.expand_ranges_split(df, "e")[1].collect())
    assert rejected == sorted((i, x) for i, x in items if not py_expand(x))


pair = st.tuples(st.sampled_from(["a", "b.c", "page", " k "]), st.none() | st.sampled_from(["", "1", "x=y", "=z"]))
query_string = st.lists(pair, max_size=5).map(lambda ps: "&".join(k if v is None else f"{k}={v}" for k, v in ps))


@SETTINGS
@given(st.lists(query_string, min_size=1, max_size=20))
def test_split_pairs_rule(spark, qs):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(qs)], "i int, q string")
    order = lambda t: (t[0], t[1], t[2] is None, t[2] or "")
    got = sorted(((r.i, r.key, r.value) for r in split_pairs(df, "q", "&", keep=["i"]).collect()), key=order)
    want = []
    for i, q in enumerate(qs):
        for p in q.split("&"):
            if p == "":
                continue
            k, sep, v = p.partition("=")
            want.append((i, k.strip(), v.strip() if sep else None))
    assert got == sorted(want, key=order)


trace_line = st.tuples(st.sampled_from(["download", "startup"]), st.none() | st.sampled_from(["spark", "kafka"]),
                       st.integers(1, 64), st.integers(0, 10**6), st.sampled_from([",", ", ", ",  "]))


@SETTINGS
@given(st.lists(trace_line, min_size=1, max_size=30))
def test_trace_rule(spark, rows):
    lines = [sep.join([p] + ([f] if f else []) + [str(n), f"{s}.5"]) for p, f, n, s, sep in rows]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, l string")
    got = {r.i: (r.phase, r.framework, r.nodes, r.seconds) for r in
           df.select("i", *[c.alias(n) for n, c in parse_trace("l").items()]).collect()}
    assert got == {i: (p, f, n, s + 0.5) for i, (p, f, n, s, _) in enumerate(rows)}
