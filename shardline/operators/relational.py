"""Projection, routing, lookups, aggregates, latest/head, set operations, expansion.

Each operator is a declarative DataFrame plan: aggregations are partial
(map-side combine) so a hot group is pre-aggregated before any shuffle;
which side of a join is broadcast is left to the optimizer, which knows the sizes;
expansions are ``explode(sequence(..))`` in the JVM.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardline.operators.ordered import dense_index
from shardline.session import drop_staged, staged


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- 25, 26: map and prefix filters ---------------------------------------

def map_values(df: DataFrame, exprs: dict[str, Column], keep: Iterable[str] = ()) -> DataFrame:
    """Apply column functions to every row (``{"sq": col("a") * col("a")}``)."""
    return df.select(*[_c(k) for k in keep], *[e.alias(n) for n, e in exprs.items()])


def filter_prefix_map(m, prefix: str) -> Column:
    """Keep the entries of a map column whose key starts with ``prefix``."""
    return F.map_filter(_c(m), lambda k, v: k.startswith(prefix))


def filter_prefix(df: DataFrame, col, prefix: str) -> DataFrame:
    """Keep rows whose string column starts with ``prefix`` (pushed to the scan
    as a ``StringStartsWith`` filter when ``col`` is a plain column)."""
    return df.filter(_c(col).startswith(prefix))


# -- 27: defaults ------------------------------------------------------------

def overlay_defaults(df: DataFrame, defaults: dict, casts: dict[str, str] | None = None) -> DataFrame:
    """Fill absent (null) fields from a default record and coerce types."""
    casts = casts or {}
    out = df
    for name, value in defaults.items():
        col = F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)
        if name in casts:
            col = col.cast(casts[name])
        out = out.withColumn(name, col)
    for name, t in casts.items():
        if name not in defaults:
            out = out.withColumn(name, F.col(name).cast(t))
    return out


def overlay_map(given, defaults: dict[str, str]) -> Column:
    """Open key/value record form: the given entries and the defaults of the keys
    that are not given."""
    items = [F.lit(x) for kv in defaults.items() for x in kv]
    given = F.coalesce(_c(given), F.create_map().cast("map<string,string>"))
    missing = F.map_filter(F.create_map(*items).cast("map<string,string>"),
                           lambda k, v: ~F.map_contains_key(given, k))
    return F.map_concat(missing, given)


# -- 28: routing ---------------------------------------------------------------

UNSUPPORTED = "unsupported"


def route_expr(col, rules: list[tuple[str, str]], default: str = UNSUPPORTED) -> Column:
    """First matching prefix wins; no match goes to the reject branch."""
    c = _c(col)
    expr = None
    for prefix, branch in rules:
        cond = c.startswith(prefix)
        expr = F.when(cond, branch) if expr is None else expr.when(cond, branch)
    return (expr.otherwise(default) if expr is not None else F.lit(default))


def route(df: DataFrame, col, rules: list[tuple[str, str]], out: str = "route") -> DataFrame:
    return df.withColumn(out, route_expr(col, rules))


def write_routes(df: DataFrame, path: str, out: str = "route", mode: str = "append") -> None:
    """Each branch lands in its own folder ``route=<branch>``."""
    df.write.mode(mode).partitionBy(out).parquet(path)


# -- 30-32: lookups ------------------------------------------------------------

def lookup_parent(children: DataFrame, parents: DataFrame, parent_key: str, parent_id: str,
                  own: str, parent_value: str, out: str = "endpoint") -> DataFrame:
    """A child naming an existing parent takes the parent's value; a child
    without (or with an unknown) parent keeps its own."""
    p = parents.select(F.col(parent_id).alias("_sl_pid"), F.col(parent_value).alias("_sl_pval"))
    j = children.join(p, children[parent_key] == p["_sl_pid"], "left")
    return j.withColumn(out, F.coalesce(F.col("_sl_pval"), F.col(own))).drop("_sl_pid", "_sl_pval")


def _pointers(jobs: DataFrame, job_id: str, parent_key: str, own: str) -> tuple[DataFrame, DataFrame]:
    """The named jobs (id, parent, value), and of each (id, ptr, hops, at_root): a pointer to
    its parent, or to itself where it names no known one. Of rows that repeat an id the
    least (parent, value) counts."""
    pick = F.min(F.struct(F.col(parent_key).alias("parent"), F.col(own).alias("value"))).alias("x")
    one = jobs.filter(F.col(job_id).isNotNull()).groupBy(F.col(job_id).alias("id")).agg(pick)
    one = staged(one.select("id", "x.parent", "x.value"), "chain-jobs")
    known = one.select(F.col("id").alias("parent_id"))
    return one, one.join(known, F.col("parent") == F.col("parent_id"), "left").select(
        "id", F.coalesce("parent_id", "id").alias("ptr"), F.col("parent_id").isNotNull().cast("bigint").alias("hops"),
        F.col("parent_id").isNull().alias("at_root"))


def lookup_chain(jobs: DataFrame, job_id: str, parent_key: str, own: str, out: str = "endpoint") -> DataFrame:
    """Every job takes the value of the job at the root of its chain of parents: an extension
    of an extension gets what the first one stands on. Adds ``out``, ``root`` (its id) and
    ``hops``; a job without a known parent is its own root, at 0 hops. Jobs on a cycle of
    parents, or whose chain ends in one, get nulls and ``cycle`` true.

    Pointer jumping: in each round a job that hasn't reached a root takes over the pointer of
    the job it points at, which doubles the steps behind it, so that chains of n jobs
    take log2(n) rounds. As a chain has a job at every depth, a round in which no job
    arrives leaves cycles only. Each round joins what is left with the pointers, both plain
    scans, so that the children of a hot parent can be split at run time."""
    one, start = _pointers(jobs, job_id, parent_key, own)
    now = staged(start, "chain-pointers")
    made, arrived = [one, now], [now.filter("at_root")]
    rest, left = now.filter("NOT at_root"), now.filter("NOT at_root").count()
    while left:
        there = rest
        for part in arrived:
            there = there.unionByName(part)
        to = there.select(F.col("id").alias("at"), F.col("ptr").alias("to"), F.col("hops").alias("more"),
                          F.col("at_root").alias("done"))
        now = staged(rest.join(to, F.col("ptr") == F.col("at")).select(
            "id", F.col("to").alias("ptr"), (F.col("hops") + F.col("more")).alias("hops"), F.col("done").alias("at_root")),
            "chain-pointers")
        made.append(now)
        arrived.append(now.filter("at_root"))
        rest = now.filter("NOT at_root")
        before, left = left, rest.count()
        if left == before:
            break
    rooted = arrived[0]
    for part in arrived[1:]:
        rooted = rooted.unionByName(part)
    values = one.select(F.col("id").alias("_sl_vid"), F.col("value").alias("_sl_value"))
    roots = rooted.join(values, F.col("ptr") == F.col("_sl_vid")).select(
        F.col("id").alias("_sl_pid"), F.col("ptr").alias("_sl_root"), F.col("hops").alias("_sl_hops"), "_sl_value",
        F.lit(False).alias("_sl_cycle"))
    looped = rest.select(F.col("id").alias("_sl_pid"), F.lit(None).cast(one.schema["id"].dataType).alias("_sl_root"),
                         F.lit(None).cast("bigint").alias("_sl_hops"),
                         F.lit(None).cast(one.schema["value"].dataType).alias("_sl_value"), F.lit(True).alias("_sl_cycle"))
    found = staged(roots.unionByName(looped) if left else roots, "chain-roots")
    drop_staged(*made)
    # a row stands on its parent's root, so that rows that repeat an id each have their own answer
    j = jobs.join(found, F.col(parent_key) == F.col("_sl_pid"), "left")
    alone = F.col("_sl_pid").isNull()
    return j.select(*(F.col(c) for c in jobs.columns), F.when(alone, F.col(own)).otherwise(F.col("_sl_value")).alias(out),
                    F.when(alone, F.col(job_id)).otherwise(F.col("_sl_root")).alias("root"),
                    F.when(alone, F.lit(0)).otherwise(F.col("_sl_hops") + 1).cast("bigint").alias("hops"),
                    F.coalesce("_sl_cycle", F.lit(False)).alias("cycle"))


def single_attachment(attachments: DataFrame, volume: str, first_by: list[str], keep: list[str]) -> DataFrame:
    """Volumes with exactly one attachment, with that attachment's fields.
    A partial aggregation (count plus per-column ``min``, which for a group of
    one row is that row): hash-aggregated, so no volume's rows are ever
    gathered in one place and no sort is needed."""
    cols = list(dict.fromkeys(first_by + keep))
    g = attachments.groupBy(volume).agg(F.count(F.lit(1)).alias("_sl_n"), *[F.min(c).alias(c) for c in cols])
    return g.filter(F.col("_sl_n") == 1).select(volume, *cols)


def match_single_attachment(attachments: DataFrame, volume: str, first_by: list[str], keep: list[str],
                            owners: DataFrame, on_left: str, on_right: str) -> DataFrame:
    """Match the single attachment of each volume to its owner (inner join)."""
    one = single_attachment(attachments, volume, first_by, keep)
    return one.join(owners, one[on_left] == owners[on_right], "inner")


def completeness(observed: DataFrame, group: str, member: str, expected: DataFrame,
                 expected_col: str) -> DataFrame:
    """Observed distinct members per group against an expected count; a
    group is complete only when they are equal (missing observations = 0)."""
    obs = observed.groupBy(group).agg(F.count_distinct(member).alias("observed"))
    j = expected.select(group, F.col(expected_col).alias("expected")).join(obs, group, "left")
    return mark_complete(j)


def mark_complete(df: DataFrame) -> DataFrame:
    """Add ``complete`` to rows with an ``expected`` and an ``observed`` number."""
    j = df.withColumn("observed", F.coalesce(F.col("observed"), F.lit(0)).cast("bigint"))
    return j.withColumn("complete", F.coalesce(F.col("observed") == F.col("expected"), F.lit(False)))


# -- 33-36: aggregates ---------------------------------------------------------

def all_in_state(df: DataFrame, group: str, state, value: str, out: str = "all_in_state") -> DataFrame:
    """Per group: every member is in ``value``; null states count as not in it."""
    cond = F.coalesce(_c(state) == F.lit(value), F.lit(False))
    return df.groupBy(group).agg(F.bool_and(cond).alias(out))


def all_in_state_for(groups: DataFrame, group: str, members: DataFrame, state, value: str,
                     out: str = "all_in_state") -> DataFrame:
    """As :func:`all_in_state` for every group of ``groups``; a group without
    members is true (as ``all([])``)."""
    agg = all_in_state(members, group, state, value, out)
    return (groups.select(group).join(agg, group, "left")
                  .withColumn(out, F.coalesce(F.col(out), F.lit(True))))


def placement_profile(df: DataFrame) -> DataFrame:
    """Rows per Spark partition and the host that ran it; ``skew`` = the
    partition's rows over the mean rows per partition. One row per partition leaves
    the scan; empty partitions have no row."""
    import pyarrow as pa

    def tally(batches):
        import socket

        rows = {}
        for batch in batches:
            for v, n in zip(*(x.to_pylist() for x in batch.column(0).value_counts().flatten())):
                rows[v] = rows.get(v, 0) + n
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(rows), pa.int32()), pa.array([socket.gethostname()] * len(rows), pa.string()),
             pa.array(list(rows.values()), pa.int64())], ["partition_id", "host", "n_rows"])

    parts = df.select(F.spark_partition_id().alias("partition_id"))
    counts = parts.mapInArrow(tally, "partition_id int, host string, n_rows long")
    return counts.withColumn("skew", F.col("n_rows") / F.avg("n_rows").over(Window.partitionBy(F.lit(0))))


def trace_summary(df: DataFrame) -> DataFrame:
    """Seconds by phase, framework, nodes: count, min, avg, max."""
    return (df.groupBy("phase", "framework", "nodes")
              .agg(F.count(F.lit(1)).alias("n"), F.min("seconds").alias("min_seconds"),
                   F.avg("seconds").alias("avg_seconds"), F.max("seconds").alias("max_seconds")))


def trailing_number(name) -> Column:
    """Trailing digits of a name as a number (null when there are none)."""
    return F.nullif(F.regexp_extract(_c(name), r"(\d+)$", 1), F.lit("")).try_cast("bigint")


def rebase_ids(new: DataFrame, existing: DataFrame, group: str, name: str, order: list[str],
               out: str = "new_id") -> DataFrame:
    """Give new members consecutive ids after the largest id already used in
    their group (the trailing number of the existing names; 0 when none
    parses), in ``order``. The per-group maximum is a partial aggregation
    (one row per group); the numbering is the distributed dense index."""
    base = (existing.groupBy(group).agg(F.max(trailing_number(name)).alias("_sl_base")))
    numbered = dense_index(new, [group], order, "_sl_idx", start=1)
    j = numbered.join(base, group, "left")
    return (j.withColumn(out, (F.coalesce(F.col("_sl_base"), F.lit(0)) + F.col("_sl_idx")).cast("bigint"))
             .drop("_sl_base", "_sl_idx"))


# -- 37-40: latest, head, distinct, append -------------------------------------

def latest_by(df: DataFrame, key, order: list[str], fields: list[str]) -> DataFrame:
    """Newest row of each key by ``order`` (later wins; the last order column
    breaks ties), as a partial ``max_by`` aggregation: a hot key is reduced to one row
    per task before the shuffle (the aggregation is sort-based, as its state is a struct)."""
    keys = [key] if isinstance(key, str) else list(key)
    pick = F.max_by(F.struct(*[F.col(f) for f in fields]), F.struct(*[F.col(o) for o in order]))
    g = df.groupBy(*keys).agg(pick.alias("_sl_latest"))
    return g.select(*keys, *[F.col("_sl_latest")[f].alias(f) for f in fields])


def head(df: DataFrame, n: int, order: list[Column | str]) -> DataFrame:
    """First ``n`` rows in a stated order (a top-k: each task keeps only its
    best ``n``, so only ``n x tasks`` rows meet at the end)."""
    return df.orderBy(*order).limit(int(n))


def distinct_members(df: DataFrame, col, out: str | None = None) -> DataFrame:
    """Distinct members after trimming blanks and line breaks."""
    c = F.regexp_replace(_c(col).cast("string"), r"^\s+|\s+$", "")
    name = out or (col if isinstance(col, str) else "member")
    return df.select(c.alias(name)).distinct()


def append_rows(*dfs: DataFrame) -> DataFrame:
    """Concatenate keeping duplicates, matching columns by name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


# -- 41, 42: expansion ---------------------------------------------------------

EXPAND_CHUNK = 1 << 16
#: A row may declare this many members; more is a broken row, not a range.
MAX_MEMBERS = (1 << 31) - 1


def range_width(lo, hi) -> Column:
    """Members of ``[lo, hi]`` as an exact decimal; null where a bound is."""
    return _c(hi).cast("decimal(20,0)") - _c(lo).cast("decimal(20,0)") + F.lit(1)


def explode_range(df: DataFrame, lo: str, hi: str, out: str, chunk: int = EXPAND_CHUNK) -> DataFrame:
    """One row per integer in ``[lo, hi]`` (no rows when ``hi < lo``, or for ranges
    wider than ``MAX_MEMBERS``, which ``range_rejects`` returns).

    Every range is cut into chunks first, and the chunks are dealt evenly over all
    tasks before they are expanded, so one row declaring billions of members does not
    become one task's work."""
    width = range_width(lo, hi)
    valid = df.filter((width >= 1) & (width <= F.lit(MAX_MEMBERS)))
    kind = df.schema[lo].dataType
    # chunk numbers and offsets from lo, so that nothing can run over the type's end
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = valid.withColumn("_sl_width", width.cast("bigint")).withColumn("_sl_c", F.explode(
        F.expr(f"sequence(0L, (_sl_width - 1) div {int(chunk)}L)"))).repartition(tasks)
    first = F.col("_sl_c") * F.lit(int(chunk))
    steps = F.sequence(first, F.least(first + F.lit(int(chunk) - 1), F.col("_sl_width") - 1))
    return (chunks.withColumn("_sl_step", F.explode(steps))
            .withColumn(out, (F.col(lo).cast("bigint") + F.col("_sl_step")).cast(kind))
            .drop("_sl_width", "_sl_c", "_sl_step"))


def range_rejects(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """The rows whose range is too wide to be one."""
    return df.filter(range_width(lo, hi) > F.lit(MAX_MEMBERS))


def expand_slots(df: DataFrame, host: str, slots: str, out: str = "slot", chunk: int = EXPAND_CHUNK) -> DataFrame:
    """One row per slot (1..n) of each ``(host, slots)``; counts that are not
    a positive integer give no rows (``expand_slots_split`` returns them)."""
    return expand_slots_split(df, host, slots, out, chunk)[0]


def expand_slots_split(df: DataFrame, host: str, slots: str, out: str = "slot",
                       chunk: int = EXPAND_CHUNK) -> tuple[DataFrame, DataFrame]:
    """(slots, rejected): the rows without slots come out with a ``reason``, ``not a count``
    or ``too many``; every input row is in one of the two."""
    n = F.col(slots).cast("string").try_cast("int")
    number = F.regexp_replace(F.trim(F.col(slots).cast("string")), r"^\+?0*", "")
    large = F.coalesce(number.rlike("^[0-9]+$") & n.isNull(), F.lit(False))
    good = df.withColumn("_sl_n", n).withColumn("_sl_one", F.lit(1)).filter("_sl_n >= 1")
    reason = F.when(large, "too many").otherwise("not a count")
    return (explode_range(good, "_sl_one", "_sl_n", out, chunk).drop("_sl_n", "_sl_one"),
            df.filter(~F.coalesce(n >= 1, F.lit(False))).withColumn("reason", reason))


def parse_host_line(line) -> dict[str, Column]:
    """``host slots`` separated by blanks."""
    parts = F.split(F.regexp_replace(_c(line), r"^\s+", ""), r"\s+")
    return {"host": F.try_element_at(parts, F.lit(1)), "slots": F.try_element_at(parts, F.lit(2))}


# Items of a compressed host list: text and [..] groups; commas inside brackets do not
# separate items, a bracket without its other half separates.
_ITEM = r"(?:[^,\[\]]|\[[^\[\]]*\])+"
_GROUP = r"\[([^\[\]]*)\]"


def _range_parts(body: Column) -> Column:
    """(lo, width, n) of the comma-separated parts of a group; no members where a part is
    descending or no number."""
    def part(x: Column) -> Column:
        lo_s, hi_s = (F.regexp_extract(x, r"^(\d+)(?:-(\d+))?$", i) for i in (1, 2))
        number = lambda t: F.nullif(t, F.lit("")).try_cast("bigint").cast("decimal(38,0)")
        lo = number(lo_s)
        n = F.coalesce(F.greatest(F.coalesce(number(hi_s), lo) - lo + 1, F.lit(0)), F.lit(0))
        return F.struct(lo.alias("lo"), F.length(lo_s).alias("width"), n.cast("decimal(38,0)").alias("n"))

    return F.transform(F.split(body, ","), part)


def expand_ranges_split(df: DataFrame, expr: str, out: str = "host",
                        chunk: int = EXPAND_CHUNK) -> tuple[DataFrame, DataFrame]:
    """(members, rejected) of compressed host lists such as ``n[01-03,07],r[1-2]u[1-4],m5``.

    An item with several groups has a member for each combination: an index counts
    through them as a number of mixed radix, one digit per group, the last one fastest. Only
    the index is expanded, in chunks dealt evenly over all tasks, and every row decodes
    its own digits, so one item of billions of members doesn't become one task's work. The
    lower bound's width sets the zero padding of each part. Members are distinct per row.

    Items without members come out of ``rejected`` (the row, ``item``, ``reason``): ``no
    member`` where a group has only descending or unparsable parts, ``too many``
    beyond ``MAX_MEMBERS``; every item is in one of the two."""
    items = (df.withColumn("_sl_item", F.explode(F.regexp_extract_all(F.col(expr), F.lit(_ITEM), 0)))
             .withColumn("_sl_groups", F.transform(F.regexp_extract_all("_sl_item", F.lit(_GROUP), 1), _range_parts)))
    size = F.transform("_sl_groups", lambda g: F.aggregate(g, F.lit(0).cast("decimal(38,0)"),
                                                           lambda n, p: (n + p["n"]).cast("decimal(38,0)")))
    most = F.lit(MAX_MEMBERS + 1).cast("decimal(38,0)")
    # sizes and products above the bound count as just above it, so that none can overflow
    sizes = F.transform(size, lambda n: F.least(n, most).cast("bigint"))
    product = F.aggregate("_sl_sizes", F.lit(1).cast("bigint"), lambda n, x: F.when((n == 0) | (x == 0), 0).otherwise(
        F.least(n.cast("decimal(38,0)") * x, most)).cast("bigint"))
    sized = items.withColumn("_sl_sizes", sizes).withColumn("_sl_total", product)
    good = (sized.filter(F.col("_sl_total").between(1, MAX_MEMBERS)).withColumn("_sl_last", F.col("_sl_total") - 1)
            .withColumn("_sl_first", F.lit(0).cast("bigint")))
    ranged = explode_range(good, "_sl_first", "_sl_last", "_sl_x", chunk)
    # the digit of a group: the index over the number of combinations behind it
    behind = lambda k: F.aggregate(F.slice("_sl_sizes", k + 2, F.size("_sl_sizes")), F.lit(1).cast("bigint"),
                                   lambda n, x: (n * x).cast("bigint"))
    digits = F.transform("_sl_sizes", lambda n, k: F.pmod(F.floor(F.col("_sl_x") / behind(k)), n))

    def member(g: Column, k: Column) -> Column:
        start = F.struct(F.get(F.col("_sl_digits"), k).cast("decimal(38,0)").alias("left"), F.lit(None).cast("string").alias("text"))

        def look(acc: Column, p: Column) -> Column:
            here = acc["text"].isNull() & (acc["left"] < p["n"])
            x = (p["lo"] + acc["left"]).cast("decimal(38,0)").cast("string")
            # pad to the lower bound's width, never cut a longer number
            text = F.lpad(x, F.greatest(p["width"], F.length(x)), F.lit("0"))
            return F.struct((acc["left"] - p["n"]).cast("decimal(38,0)").alias("left"),
                            F.when(here, text).otherwise(acc["text"]).alias("text"))

        return F.aggregate(g, start, look)["text"]

    texts = F.split("_sl_item", _GROUP, -1)
    name = F.concat(F.get(texts, F.lit(0)), F.array_join(F.transform(
        "_sl_groups", lambda g, k: F.concat(member(g, k), F.get(texts, k + 1))), ""))
    members = ranged.withColumn("_sl_digits", digits).select(*df.columns, name.alias(out)).distinct()
    reason = F.when(F.col("_sl_total") == 0, "no member").otherwise("too many")
    rejected = sized.filter(~F.col("_sl_total").between(1, MAX_MEMBERS)).select(
        *df.columns, F.col("_sl_item").alias("item"), reason.alias("reason"))
    return members, rejected


def expand_ranges(df: DataFrame, expr: str, out: str = "host", chunk: int = EXPAND_CHUNK) -> DataFrame:
    """The members of compressed host lists, see :func:`expand_ranges_split`."""
    return expand_ranges_split(df, expr, out, chunk)[0]
