"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Ratings have ordered grades (0: toxic, 1: poor, 2: good). All grades share one weight
vector over hashed text features; ordered thresholds cut its scale into grades:
P(grade <= k) = sigmoid(threshold_k - weights . features). The expected grade and the
tail probability P(grade >= 2) select documents.

Features are present or absent: the distinct words of the whole text, their first four
and five letters, and the text's shape (shares of words with symbol tails, in capitals
or equal to the word before, in bins). The model is fitted on a sample of rated
documents, those whose hash is below a bound, ``max_rows`` of them on average; every
document is scored.

Defined results: a null or empty text has its shape as its only feature; a rating with
null quality and no toxicity teaches nothing, and of several ratings of a document each
counts; without ratings of two grades at least every document is kept with
expected grade 2; rows that repeat an id are scored each on their own; an empty table
gives an empty result. Input columns may have any names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardline.llm.common import Memo, giving_back
from shardline.session import ship_package

BITS, MAX_ROWS, STEPS, GRADES, SHAPE = 18, 16_384, 150, 3, 6
LEAST = 0.5  # documents of at least this probability of the highest grade are kept: held-out ratings lose 0.3 % of good ones
SHRINK = 5e-4  # of the weights, beside the mean log-likelihood
ROWS, BLOCK = 128, 512
_SCALE = 1 << 20
_EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~"


class Features:
    """Hashed features of texts; what a word gives is remembered, in a table of
    bounded size."""

    def __init__(self, bits: int = BITS):
        # an entry takes some 80 bytes beside those that are counted
        self.mask, self.known = (1 << bits) - 1, Memo(12 << 20)

    def _slot(self, name: str) -> int:
        return zlib.crc32(name.encode("utf-8", "replace")) & self.mask

    def _word(self, raw: str) -> tuple:
        word = raw.strip(_EDGE)
        tail = len(raw) - len(raw.rstrip(_EDGE))
        low = word.lower()
        slots = tuple(self._slot(x) for x in ("w:" + low, "4:" + low[:4], "5:" + low[:5])) if word else ()
        out = (slots, tail > 1 or not word, len(word) > 1 and word == word.upper() != low)
        self.known.keep(raw, out)
        return out

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct feature numbers."""
        raw = (text or "").split()
        slots, symbols, capitals = set(), 0, 0
        for w, n in Counter(raw).items():
            s, sym, cap = self.known.get(w) or self._word(w)
            slots.update(s)
            symbols += n * sym
            capitals += n * cap
        total = max(len(raw), 1)
        again = sum(map(eq, raw, raw[1:]))
        for name, n in (("symbols", symbols), ("capitals", capitals), ("again", again)):
            share = n / total
            level = 0 if not n else 1 + int(min(9, 10 * share))
            # a shape is worth several words: it has as many features
            slots.update(self._slot(f"s:{name}:{k}:{i}") for k in range(level + 1) for i in range(SHAPE))
        slots.add(self._slot(f"s:size:{len(raw).bit_length()}"))
        return np.array(sorted(slots), np.int32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class OrdinalModel:
    def __init__(self, weight: np.ndarray, cuts: np.ndarray):
        self.weight, self.cuts = weight, cuts

    def tails(self, feats: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return _sigmoid(self.weight[feats].sum() - self.cuts)


def fit(feats: list[np.ndarray], grades: np.ndarray, bits: int = BITS, steps: int = STEPS,
        shrink: float = SHRINK) -> OrdinalModel | None:
    """Maximum likelihood by full-batch AdaGrad. Thresholds stay in order: the first
    is free, each further one is the last plus an exponential. Each step goes through
    the documents in blocks, so that it needs little beside the features themselves."""
    grades = np.asarray(grades, int)
    if len(set(grades.tolist())) < 2:
        return None
    n = len(grades)
    sizes = np.array([len(f) for f in feats])
    blocks = [(slice(lo, lo + BLOCK), np.concatenate(feats[lo:lo + BLOCK]).astype(np.int32, copy=False),
               np.cumsum(sizes[lo:lo + BLOCK]) - sizes[lo:lo + BLOCK]) for lo in range(0, n, BLOCK)]
    weight = np.zeros(1 << bits)
    first, gaps = -2.0, np.zeros(GRADES - 2)
    seen, seen_t = np.full(weight.shape, 1e-8), np.full(GRADES - 1, 1e-8)
    for _ in range(steps):
        cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        s = np.concatenate([np.add.reduceat(weight[cols], begin) for _, cols, begin in blocks])
        upper = _sigmoid(np.append(cuts, np.inf)[grades] - s)  # P(y <= grade)
        lower = _sigmoid(np.append(-np.inf, cuts)[grades] - s)
        # d log P / d s, for P = upper - lower of the logistic distribution
        slope = -(1 - upper - lower)
        up, low = upper * (1 - upper), lower * (1 - lower)
        p = np.maximum(upper - lower, 1e-9)
        g = shrink * weight
        for rows, cols, _ in blocks:
            g -= np.bincount(cols, np.repeat(slope[rows], sizes[rows]), len(weight)) / n
        per_cut = np.array([np.sum((grades == k) * up / p) - np.sum((grades == k + 1) * low / p)
                            for k in range(GRADES - 1)]) / -n
        g_cut = np.concatenate([[per_cut.sum()],
                                [per_cut[j + 1:].sum() * np.exp(gaps[j]) for j in range(GRADES - 2)]])
        seen += g * g
        seen_t += g_cut * g_cut
        weight -= 0.3 * g / np.sqrt(seen)
        move = 0.3 * g_cut / np.sqrt(seen_t)
        first, gaps = first - move[0], gaps - move[1:]
    return OrdinalModel(weight, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def grade_of(quality: str = "quality", toxic: str = "toxic"):
    return F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 0, 1).when(F.col(quality) == 1, 2)


def train(docs: DataFrame, ratings: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS,
          steps: int = STEPS) -> OrdinalModel | None:
    """``docs`` has id, text; ``ratings`` id, grade. Features of about ``max_rows``
    documents come to the driver."""
    rated = ratings.filter("id IS NOT NULL AND grade IS NOT NULL")
    share = min(_SCALE, -(-max_rows * _SCALE // max(rated.count(), 1)))
    sample = rated.filter(F.pmod(F.xxhash64("id"), F.lit(_SCALE)) < share)
    joined = docs.join(F.broadcast(sample), "id")  # about max_rows rows of two numbers

    @giving_back
    def features(batches):
        made = Features(bits)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                feats = [made.of(t) for t in batch.column(2).slice(at, ROWS).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, ROWS), batch.column(1).slice(at, ROWS),
                     pa.array(feats, pa.list_(pa.int32()))], ["id", "grade", "feats"])

    kind = docs.schema["id"].dataType.simpleString()
    rows = joined.select("id", "grade", "text").mapInArrow(
        features, f"id {kind}, grade int, feats array<int>").toArrow()
    # the same sums in the same order, whatever order the rows come in
    order = pc.sort_indices(rows.select(["id", "grade"]), [("id", "ascending"), ("grade", "ascending")]).to_pylist()
    listed = rows.column("feats")
    feats, grades = [listed[i].values.to_numpy() for i in order], rows.column("grade").to_numpy()[order]
    return fit(feats, grades, bits, steps) if feats else None


def rate(df: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", rated_id: str = "doc_id",
         quality: str = "quality", toxic: str = "toxic", max_rows: int = MAX_ROWS, bits: int = BITS,
         steps: int = STEPS) -> DataFrame:
    """The input rows as struct ``row`` with ``expected_grade`` and ``p_good``, the
    probability of the highest grade."""
    spark = df.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(train(
        df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
        ratings.select(F.col(rated_id).alias("id"), grade_of(quality, toxic).cast("int").alias("grade")),
        max_rows, bits, steps))
    top = float(GRADES - 1)

    @giving_back
    def grades(batches):
        made = Features(bits)
        for texts in batches:
            tails = [model.value.tails(made.of(t)) if model.value else None for t in texts]
            yield pd.DataFrame({"expected_grade": [top if t is None else float(t.sum()) for t in tails],
                                "p_good": [1.0 if t is None else float(t[-1]) for t in tails]})

    @F.pandas_udf("struct<expected_grade:double,p_good:double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return grades(batches)

    return df.select(F.struct("*").alias("row"), scored(F.col(text_col)).alias("s")).select("row", "s.*")


def select_good(df: DataFrame, ratings: DataFrame, least: float = LEAST, **options) -> DataFrame:
    """The rows of ``df`` that are good with probability ``least`` or more."""
    return rate(df, ratings, **options).filter(F.col("p_good") >= least).select("row.*")
