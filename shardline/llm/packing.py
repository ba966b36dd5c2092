"""Packing of documents into sequences of bounded length by Karmarkar-Karp
multiway differencing.

Each document's ids (and an end id) are cut into pieces: full sequences first,
each a sequence of its own; the remainder at multiples of ``cut``, so that every
window has several pieces to balance. Remainders are dealt by hash into blocks of
about ``windows`` windows. In a block, differencing starts with one partial
partition per piece and merges the two of the largest spread, largest sums of one
with the smallest of the other, until one near-equal partition into k windows is
left; k starts at the least possible count and rises while a window exceeds the
capacity.

Defined results: a null or empty text is the end id alone; rows that repeat a
doc_id are packed each on their own; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardline.llm.common import give_back, giving_back, staged
from shardline.llm.tokens import WordIds, run_bounds, tokenizer_json
from shardline.session import ship_package

CAPACITY, CUT, WINDOWS, END_ID = 2048, 512, 128, 1


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: the items of ``sizes`` in k near-equal groups (indices).

    A partial partition holds its non-empty groups as (sum, items), largest sum
    first; the groups that are missing up to k are empty."""
    heap = [(-s, i, [(s, (i,))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        alone = k - len(b)  # this many of a's largest meet an empty group of b
        if alone >= len(a):
            groups = a + b
        else:
            groups = a[:alone] + b[:k - len(a)]
            for (s, x), (t, y) in zip(a[alone:], reversed(b[k - len(a):])):
                groups.append((s + t, x + y))
        groups.sort(key=lambda g: -g[0])
        low = groups[-1][0] if len(groups) == k else 0
        heapq.heappush(heap, (low - groups[0][0], tick, groups))
        tick += 1
    return [list(x) for _, x in heap[0][2]] if heap else []


def windows_of(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """The least k, from the total on, whose differencing keeps within capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = difference(sizes, k)
        if max((sum(sizes[i] for i in g) for g in groups), default=0) <= capacity:
            return groups
        k += 1


def document_pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str,
                    capacity: int, cut: int, end_id: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece."""
    ship_package(df.sparkSession)
    spec = df.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer))
    end = int(end_id).to_bytes(4, "little")

    @giving_back
    def pieces(batches):
        words = WordIds(spec.value)
        for batch in batches:
            for at, rows in run_bounds(batch.column(1)):
                ids, texts = batch.column(0).slice(at, rows), batch.column(1).slice(at, rows).fill_null("")
                row, start, length, crc, total = [], [], [], [], []
                for i, data in enumerate(words.of(texts)):
                    data += end
                    n = len(data) // 4
                    full = n - n % capacity
                    for lo, hi in ([(s, s + capacity) for s in range(0, full, capacity)]
                                   + [(s, min(s + cut, n)) for s in range(full, n, cut)]):
                        row.append(i), start.append(lo), length.append(hi - lo), total.append(n)
                        crc.append(zlib.crc32(data[4 * lo:4 * hi]))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        pieces, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str = "word_bpe_49k.json",
         capacity: int = CAPACITY, cut: int = CUT, windows: int = WINDOWS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Only numbers are shuffled, never ids or texts. A full piece's sequence has an
    odd id, a window an even one made of its block and its place there."""
    cut_up = staged(document_pieces(df, id_col, text_col, tokenizer, capacity, cut, end_id)
                    .withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    full = cut_up.filter(F.col("length") == capacity).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (2 * F.col("uid") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut_up.filter(F.col("length") < capacity)
    total = rest.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // (capacity * windows)))
    block = F.pmod(F.xxhash64("uid"), F.lit(blocks).cast("long"))

    def place(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        sizes = pdf["length"].tolist()
        seq, off = [0] * len(sizes), [0] * len(sizes)
        for w, group in enumerate(windows_of(sizes, capacity)):
            at = 0
            for i in sorted(group):
                seq[i], off[i] = 2 * ((int(key[0]) << 24) + w), at
                at += sizes[i]
        give_back()
        return pdf.drop(columns=["uid", "block"]).assign(sequence_id=seq, offset=off)

    kind = df.schema[id_col].dataType.simpleString()
    packed = (rest.withColumn("block", block).groupBy("block").applyInPandas(
        place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
               "sequence_id long, offset long"))
    return full.unionByName(packed)
