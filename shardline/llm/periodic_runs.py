"""Periodic runs of words, by recompression and grammar LCE queries.

A run is a stretch of consecutive words of smallest period q (words q apart are equal), of
``max(least, 2 q)`` words or more, that neither neighbour extends.

1. Recompression. The words of a batch of texts, one after the other with a mark around
   each text, are compressed in turns: blocks of one symbol become one symbol each, then
   the pairs whose left symbol falls into one half of the alphabet and whose right symbol
   into the other become one symbol each. The rounds make a run-length grammar of some
   log(n) levels; equal stretches are compressed alike except at their ends.
2. Extensions. How far two places agree is answered level by level: a query climbs while
   the symbols agree, after one step to the end of a symbol that it starts inside of, and
   goes back down to the first word that differs. All queries of a batch move through the
   levels together; extensions to the left use the mirrored levels.
3. Candidates. For each period p the places of a grid of step ``max(p, least - p)`` are
   compared with the places p further: of a run of period p the grid meets at least one
   place. A place that agrees is extended both ways, which gives the whole run, whatever
   its length. Of equal stretches the one of the least period stays, as all other periods
   of such a stretch are its multiples.

Defined results: a null or empty text and one of blanks only has no runs and collapses to
the empty text; texts are never cut; rows that repeat an id are judged each on their own;
an empty table gives an empty result. Only the named columns are looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardline.llm.common import WORD_BREAK, let
from shardline.session import ship_package

LEAST, BATCH_WORDS, CHUNK = 12, 100_000, 1 << 19
RUNS = "array<struct<start:long,length:long,period:long>>"
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
MARK = 0  # the symbol between texts; never compressed


@dataclass
class Level:
    """The symbols of a level, and of each symbol of the next one where it begins here."""

    sym: np.ndarray
    start: np.ndarray  # one more than there are symbols above: the last is len(sym)
    up: np.ndarray     # number of the symbol above that holds the place
    block: bool

    def mirrored(self) -> "Level":
        n = len(self.sym)
        return Level(self.sym[::-1], (n - self.start)[::-1], (len(self.start) - 2 - self.up)[::-1], self.block)


def _level(sym: np.ndarray, begins: np.ndarray, block: bool) -> Level:
    start = np.append(np.flatnonzero(begins), len(sym)).astype(np.int32)
    return Level(sym, start, np.cumsum(begins, dtype=np.int32) - 1, block)


def _named(key: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Symbols of the level above: equal keys get equal numbers, marks stay marks."""
    names = pd.factorize(key)[0].astype(np.int32) + 1
    names[marks] = MARK
    return names


def recompress(words: np.ndarray, seed: int = 7) -> list[Level]:
    """The grammar of symbols (numbers from 1, ``MARK`` between texts)."""
    rng, levels, sym = np.random.default_rng(seed), [], words.astype(np.int32)
    while True:
        solid = sym != MARK
        if not (solid[1:] & solid[:-1]).any():
            return levels
        begins = np.ones(len(sym), bool)
        begins[1:] = (sym[1:] != sym[:-1]) | ~solid[1:]
        if not begins.all():
            level = _level(sym, begins, True)
            at, size = level.start[:-1], np.diff(level.start).astype(np.int64)
            levels.append(level)
            sym = _named(sym[at] * (size.max() + 1) + size, ~solid[at])
            solid = sym != MARK
        half = rng.random(int(sym.max()) + 1) < 0.5
        left, right = half[sym] & solid, ~half[sym] & solid
        one, other = left[:-1] & right[1:], right[:-1] & left[1:]
        pair = one if one.sum() >= other.sum() else other
        if pair.any():
            begins = np.ones(len(sym), bool)
            begins[1:] = ~pair
            level = _level(sym, begins, False)
            at = level.start[:-1]
            paired = np.append(pair, False)[at]
            after = np.where(paired, sym[np.minimum(at + 1, len(sym) - 1)].astype(np.int64) + 1, 0)
            levels.append(level)
            sym = _named(sym[at] * (np.int64(sym.max()) + 2) + after, ~solid[at])


def agreement(levels: list[Level], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many symbols agree from the places x and y on, which differ and lie in one text
    or on the mark before it."""
    x0, x, y = x, x.copy(), y.copy()
    stop = np.full(len(x), len(levels))
    active = np.arange(len(x))
    for h, level in enumerate(levels):
        if not len(active):
            break
        ax, ay = x[active], y[active]
        same = level.sym[ax] == level.sym[ay]
        stop[active[~same]] = h
        active, ax, ay = active[same], ax[same], ay[same]
        px, py = level.up[ax], level.up[ay]
        inside = (level.start[px] != ax) | (level.start[py] != ay)
        rx, ry = level.start[px + 1] - ax, level.start[py + 1] - ay
        step = np.where(inside, np.minimum(rx, ry) if level.block else 1, 0)
        x[active], y[active] = ax + step, ay + step
        apart = inside & (rx != ry) if level.block else np.zeros(len(ax), bool)
        stop[active[apart]] = h  # one block ends here, the other goes on
        active = active[~apart]
        x[active], y[active] = level.up[x[active]], level.up[y[active]]
    order = np.argsort(-stop, kind="stable")
    x, y, falling = x[order], y[order], -stop[order]
    for h in range(len(levels) - 1, -1, -1):
        n = np.searchsorted(falling, -h, "left")  # those that stopped above level h
        level = levels[h]
        px, py = x[:n], y[:n]
        ax, ay = level.start[px], level.start[py]
        size = np.minimum(level.start[px + 1] - ax, level.start[py + 1] - ay) if level.block else 1
        step = np.where(level.sym[ax] == level.sym[ay], size, 0)
        x[:n], y[:n] = ax + step, ay + step
    out = np.empty(len(x), np.int64)
    out[order] = x
    return out - x0


def _grid(sizes: np.ndarray, offsets: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place) of the harmonic grids of all texts, in chunks."""
    fits = np.flatnonzero(sizes >= least)
    text = np.repeat(fits, sizes[fits] // 2)
    if not len(text):
        return
    first = np.append(0, np.cumsum(sizes[fits] // 2))[:-1]
    period = np.arange(len(text)) - np.repeat(first, sizes[fits] // 2) + 1
    step = np.maximum(period, least - period)
    count = -(-(sizes[text] - period) // step)
    ends = np.cumsum(count)
    lo = 0
    while lo < len(text):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
        n = count[lo:hi]
        k = np.arange(ends[hi - 1] - done) - np.repeat(ends[lo:hi] - n - done, n)
        row = np.repeat(np.arange(lo, hi), n)
        yield text[row], period[row], offsets[text[row]] + k * step[row]
        lo = hi


def _least_period(found: np.ndarray) -> np.ndarray:
    """Rows of (text, start, end, period): of each stretch the least period."""
    found = found[np.lexsort(found.T[::-1])]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :3] != found[:-1, :3]).any(1)
    return found[new]


def runs_of(texts: list[np.ndarray], least: int = LEAST) -> np.ndarray:
    """(text, start, length, period) of all runs of texts given as word numbers from 1,
    by text, start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.cumsum(sizes + 1) - sizes  # a mark before each text and one at the end
    symbols = np.full(int((sizes + 1).sum()) + 1, MARK, np.int32)
    for t, o in zip(texts, offsets):
        symbols[o:o + len(t)] = t
    levels = back = None
    found = []
    for text, period, at in _grid(sizes, offsets, least):
        hit = symbols[at] == symbols[at + period]
        if not hit.any():
            continue
        if levels is None:
            levels = recompress(symbols)
            back = [level.mirrored() for level in levels]
        text, period, at = text[hit], period[hit], at[hit]
        ahead = agreement(levels, at, at + period)
        last = len(symbols) - 1
        behind = agreement(back, last - (at + period - 1), last - (at - 1))
        good = period + ahead + behind >= np.maximum(least, 2 * period)
        start = at - behind - offsets[text]
        found.append(_least_period(np.stack(
            [text, start, start + behind + period + ahead, period], 1)[good]))
    if not found:
        return np.empty((0, 4), np.int64)
    out = _least_period(np.concatenate(found))
    out = out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]
    out[:, 2] -= out[:, 1]
    return out


def _judged(batch: list[list[str]], least: int) -> tuple[list[list[dict]], list[str]]:
    """Runs and collapsed texts of a batch of texts given as words."""
    number: dict[str, int] = {}
    coded = [np.array([number.setdefault(w, len(number) + 1) for w in words], np.int32) for words in batch]
    found = runs_of(coded, least)
    at = np.searchsorted(found[:, 0], np.arange(len(batch) + 1))
    runs, collapsed = [], []
    for k, words in enumerate(batch):
        own = found[at[k]:at[k + 1], 1:]
        if len(own):
            start, length, period = own.T
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, start + length, -1)
            words = [w for w, n in zip(words, np.cumsum(change)) if not n]
        runs.append([{"start": s, "length": n, "period": p} for s, n, p in own.tolist()])
        collapsed.append(" ".join(words))
    return runs, collapsed


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (by start and period), collapsed of every row; the collapsed
    text leaves out each word that a run contains after its first period."""
    ship_package(df.sparkSession)

    def work(batches):
        for batch in batches:
            lo, size, words = 0, 0, []
            for k, text in enumerate(batch.column(1)):
                words.append(_WORDS.findall(text.as_py() or ""))
                size += len(words[-1])
                if size >= BATCH_WORDS or k == batch.num_rows - 1:
                    runs, collapsed = _judged(words, least)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(lo, len(words)), pa.array([len(w) for w in words], pa.int64()),
                         pa.array(runs, pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))),
                         pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
                    lo, size, words = k + 1, 0, []

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        work, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def repeated_tail(text: Column, number: Column) -> Column:
    """The text with the words from a on replaced by repeats of the p words there: for n
    words and g = ``number``, a = g % n and p = 1 + (n - a) // (3 + g % 8)."""
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")

    def tail(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(number, n)
        p = F.floor((n - a) / (3 + F.pmod(number, F.lit(8)))) + 1
        return F.when(n > 0, let(F.struct(a.alias("a"), p.alias("p")), lambda s: F.array_join(F.transform(
            F.sequence(F.lit(0).cast("long"), n - 1),
            lambda i: F.get(w, F.when(i < s["a"], i).otherwise(s["a"] + F.pmod(i - s["a"], s["p"])).cast("int"))), " ")))

    return F.coalesce(let(words, tail), F.lit(""))


def runs_digest(df: DataFrame) -> DataFrame:
    """The contract's columns, one row per row of ``df``: of every tenth document by the
    hash of its id, the end is first made periodic."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    text = F.when(F.pmod(h, F.lit(10)) == 0, repeated_tail(F.col("text"), F.floor(h / 10))).otherwise(F.col("text"))
    found = periodic_runs(df.select("doc_id", text.alias("text")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"),
                                                                 (-r["period"]).alias("p"))))
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"),
        F.col("best.l").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.l") / -F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "").cast("binary"), 256)
        .alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
