"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables,
exact cosine verification, distributed connected components.

Vectors that are equal bit for bit (with the same label) are one class; one
vector of each class is hashed. The bits of a code follow from the number of classes of
the label, so that a bucket holds some ``FILL`` of them however large the label is, and
the number of tables from the bits: at the threshold two signs agree with probability
a = 1 - acos(threshold) / pi, 0.88 for 0.93, and with n tables of b bits a pair is found
with probability 1 - (1 - a**b)**n, ``RECALL`` or more, and more the closer it is.
In each table, vectors of one label and one code are compared pair by pair in double
precision, many buckets per call, in blocks of bounded size: a bucket with more
than ``block`` classes becomes several block pairs, none of which is left out. A pair that
meets in several tables counts in the first of them only.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite
component, and vectors without label or id, link with nothing, and are their own
component; vectors of different length never link; rows that repeat a vec_id are
vectors of their own with that id; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardline.llm.common import drop_staged, staged
from shardline.llm.components import connected
from shardline.operators.ordered import KeyRuns
from shardline.session import ship_package

THRESHOLD, RECALL, FILL, LEAST_BITS, MOST_BITS, BLOCK, SEED = 0.93, 0.98, 32, 4, 30, 512, 20240


def bits_for(classes: int, fill: int = FILL) -> int:
    """Bits of a code for a label of that many classes."""
    return min(MOST_BITS, max(LEAST_BITS, round(math.log2(max(classes, 1) / fill))))


def tables_for(bits: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Tables that find a pair at the threshold with probability ``recall``."""
    agree = 1 - math.acos(threshold) / math.pi
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree ** bits)))


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy())


def _planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def sign_codes(vectors: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """(n, tables) codes: the signs of ``bits`` random projections each."""
    signs = vectors @ _planes(vectors.shape[1], bits, tables, seed) > 0
    return signs.reshape(len(vectors), tables, bits) @ (1 << np.arange(bits))


def links_in_block(unit: np.ndarray, vectors: np.ndarray, codes: np.ndarray, table: int, side: np.ndarray, same: bool,
                   threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the block at or above the threshold that no earlier table holds.
    ``same``: all pairs; else only those between side 0 and side 1."""
    if same:
        cosine = unit @ unit.T
        x, y = np.nonzero(cosine >= threshold - 1e-9)
        x, y = x[x < y], y[x < y]
        at = cosine[x, y]
    else:
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        cosine = unit[a] @ unit[b].T
        x, y = np.nonzero(cosine >= threshold - 1e-9)
        at = cosine[x, y]
        x, y = a[x], b[y]
    if table and len(x):
        new = ~(codes[x, :table] == codes[y, :table]).any(1)
        x, y, at = x[new], y[new], at[new]
    # the product may differ in the last places: those at the edge are judged one by one
    edge = np.flatnonzero(at < threshold + 1e-9)
    if len(edge):
        v, w = vectors[x[edge]], vectors[y[edge]]
        exact = (v * w).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((w * w).sum(1)))
        keep = np.ones(len(x), bool)
        keep[edge[exact < threshold]] = False
        x, y = x[keep], y[keep]
    return x, y


def block_roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For 0..n-1 the least number linked to each, over any number of links."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[x], root[y])
        then = root.copy()
        np.minimum.at(then, x, least)
        np.minimum.at(then, y, least)
        then = then[then]
        if (then == root).all():
            return root
        root = then


def dedup_embeddings(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                     threshold: float = THRESHOLD, recall: float = RECALL, fill: int = FILL, block: int = BLOCK,
                     seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = df.sparkSession
    ship_package(spark)
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"),
                     F.col(vector_col).alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0)
              & ~F.coalesce(bad, F.lit(True)) & F.exists("vec", lambda x: x != 0))
    keyed = rows.withColumn("ok", F.coalesce(usable, F.lit(False))).select(
        "vec_id", "label", "vec", "ok", F.xxhash64("label", "vec").alias("k1"),
        F.xxhash64(F.lit(1), "label", "vec").alias("k2"))
    classes = staged(
        keyed.filter("ok").groupBy("k1", "k2").agg(
            F.min("vec_id").alias("rep"), F.count("*").alias("copies"),
            F.first("label").alias("label"), F.first("vec").alias("vec")), "embed-classes")

    # vectors travel in the table's own precision; all arithmetic is in double
    held = np.float32 if classes.schema["vec"].dataType.elementType.typeName() == "float" else np.float64

    def coded(batches):
        for batch in batches:
            lens = _lengths(batch.column(2))
            bits = np.array([bits_for(n, fill) for n in batch.column(4).to_numpy()])
            for dim, b in sorted(set(zip(lens.tolist(), bits.tolist()))):
                part = batch.filter(pa.array((lens == dim) & (bits == b)))
                vecs = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(held).reshape(-1, dim)
                codes = sign_codes(vecs.astype(float), b, tables_for(b, threshold, recall), seed)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(3), pa.array([int(dim)] * len(vecs), pa.int32()),
                     pa.array([v.tobytes() for v in vecs], pa.binary()),
                     pa.array(codes.astype(np.int32).tolist(), pa.list_(pa.int32()))],
                    ["rep", "copies", "label", "dim", "vec", "codes"])

    id_kind, label_kind = keyed.schema["vec_id"].dataType.simpleString(), keyed.schema["label"].dataType.simpleString()
    per_label = staged(classes.groupBy("label").agg(F.count("*").alias("n_label")), "embed-labels")
    hashed = staged(
        classes.join(per_label, "label").select("rep", "copies", "vec", "label", "n_label").mapInArrow(
            coded, f"rep {id_kind}, copies long, label {label_kind}, dim int, vec binary, codes array<int>"),
        "embed-codes")
    bucket = ["label", "dim", "tab", "code"]
    large = staged(hashed.select("label", "dim", F.posexplode("codes").alias("tab", "code")).groupBy(*bucket).count()
                   .filter(F.col("count") > block).select(
                       *bucket, F.ceil(F.col("count") / block).cast("int").alias("blocks")), "embed-buckets")
    placed = (hashed.select("*", F.posexplode("codes").alias("tab", "code")).join(large, bucket, "left")
              .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
              .withColumn("i", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))
    keys = [*bucket, "lo", "hi"]
    paired = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *bucket, F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"),
        (F.col("i") > F.col("j")).cast("int").alias("side"), "rep", "copies", "vec", "codes")

    def linked(batches):
        def judged(table: pa.Table, starts: list[int]) -> pa.RecordBatch:
            batch = table.combine_chunks().to_batches()[0]
            dims, tabs, los, his = (batch.column(c).to_numpy() for c in ("dim", "tab", "lo", "hi"))
            side, copies, rep = batch.column("side").to_numpy(), batch.column("copies").to_numpy(), batch.column("rep")
            vecs, codes = batch.column("vec").to_pylist(), batch.column("codes")
            who, to, count = [], [], []
            for lo, hi in zip(starts, starts[1:]):
                if hi - lo < 2:
                    continue
                v = np.frombuffer(b"".join(vecs[lo:hi]), held).astype(float).reshape(hi - lo, dims[lo])
                unit = v / np.sqrt((v * v).sum(1))[:, None]
                own = codes.slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, -1)
                x, y = links_in_block(unit, v, own, int(tabs[lo]), side[lo:hi], los[lo] == his[lo], threshold)
                if len(x):
                    n = np.bincount(x, copies[lo:hi][y], hi - lo) + np.bincount(y, copies[lo:hi][x], hi - lo)
                    some = np.flatnonzero(n)
                    who.append(lo + some)
                    to.append(lo + block_roots(hi - lo, x, y)[some])
                    count.append(n[some].astype(np.int64))
            at = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([rep.take(pa.array(at(who))), pa.array(at(count), pa.int64()),
                                               rep.take(pa.array(at(to)))], ["rep", "n", "root"])

        pending = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (pa.concat_tables([pending, table]) if pending is not None else table).combine_chunks()
            if not table.num_rows:
                continue
            starts = np.flatnonzero(KeyRuns(keys).starts(table)).tolist()
            if len(starts) > 1:  # the last block may go on in the next batch
                yield judged(table.slice(0, starts[-1]), starts)
            pending = table.slice(starts[-1])
        if pending is not None and pending.num_rows:
            yield judged(pending, [0, pending.num_rows])

    found = staged(paired.repartition(*keys).sortWithinPartitions(*keys, "rep").mapInArrow(
        linked, f"rep {id_kind}, n long, root {id_kind}"), "embed-links")
    comp = connected(found, "rep", "root")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    result = staged(
        classes.select("k1", "k2", "rep", "copies").join(counts, "rep", "left")
        .join(comp, F.col("rep") == F.col("node"), "left")
        .select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("component")), "embed-result")
    drop_staged(classes, per_label, hashed, large, found)
    # both sides are plain scans: the rows of a hot vector can be split at run time
    joined = keyed.select("vec_id", "ok", "k1", "k2").join(result, ["k1", "k2"], "left")
    linked_to = F.col("ok") & F.col("n_links").isNotNull()
    return joined.select(
        "vec_id", F.when(linked_to, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(linked_to, F.col("component")).otherwise(F.col("vec_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
