"""Language identification by words first, character n-grams for unseen words.

A word that the model knows scores its log frequency in each language. An unseen
word falls back to the character n-grams of ``^word$``: of the longest order at
which the model knows any of its n-grams, the mean of their log frequencies. A text's
score is the sum over all its words; the language with the largest sum wins, ties go
to the first in the alphabet, and the score is its share under equal priors.

The model is learned from a sample of labelled documents of each language: those whose hash is
below a bound, ``max_docs`` of them on average. Of each language it holds the ``max_words`` words
and ``max_grams`` n-grams that are most frequent there, with their counts in all
languages, so that a language of few documents is learned beside one of many. Prediction
reads whole texts.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and
for all texts if nothing can be learned; documents without id or language are not
learned from, and a null id is not held out; rows that repeat an id are predicted each
on their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardline.llm.common import drop_staged, staged
from shardline.session import ship_package

#: Each per language.
MAX_DOCS, MAX_WORDS, MAX_GRAMS = 5_000, 15_000, 15_000
ORDERS = (5, 4, 3, 2, 1)
REMEMBER, ROWS = 250_000, 256
_WORD = regex.compile(r"\p{L}+")
_SCALE = 1 << 20


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str, order: int) -> list[str]:
    marked = f"^{word}$" if order > 1 else word
    return [marked[i:i + order] for i in range(len(marked) - order + 1)]


class Model:
    """Log frequencies by language; ``counts`` maps words (and, apart, n-grams) to
    their counts per language."""

    def __init__(self, langs: list[str], word_counts: dict, gram_counts: dict):
        self.langs = langs
        self.word = self._logs(word_counts)
        self.gram = {}
        for order in ORDERS:
            self.gram |= self._logs({g: c for g, c in gram_counts.items() if len(g) == order})

    @staticmethod
    def _logs(counts: dict) -> dict:
        if not counts:
            return {}
        table = np.array(list(counts.values()), float)
        total = np.maximum(table.sum(0), 1)
        # what a language doesn't know weighs the same in all, however little was learned of it
        return dict(zip(counts, np.log(table / total + 0.1 / total.max())))

    def score_word(self, word: str) -> np.ndarray:
        known = self.word.get(word)
        if known is not None:
            return known
        for order in ORDERS:
            found = [self.gram[g] for g in grams(word, order) if g in self.gram]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(self.langs))


class Predictor:
    """Scores texts; remembers words in a table of bounded size."""

    def __init__(self, model: Model):
        self.model, self.at = model, {}
        self.table = np.zeros((REMEMBER, len(model.langs)))

    def _row(self, word: str) -> np.ndarray:
        score = self.model.score_word(word)
        if len(self.at) < REMEMBER and len(word) <= 40:
            self.table[len(self.at)] = score
            self.at[word] = len(self.at)
        return score

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words(text or "")
        if not found or not self.model.langs:
            return "und", 0.0
        at = list(map(self.at.get, found))
        total = np.zeros(len(self.model.langs))
        if None in at:
            for w, k in zip(found, at):
                if k is None:
                    total += self.table[self.at[w]] if w in self.at else self._row(w)
            at = [k for k in at if k is not None]
        if at:
            total += self.table[at].sum(0)
        best = int(total.argmax())
        return self.model.langs[best], float(1 / np.exp(total - total[best]).sum())


def _counted(sample: DataFrame) -> DataFrame:
    def count(batches):
        totals = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                totals.update((lang, w) for w in words(text))
        rows = Counter()
        for (lang, w), n in totals.items():
            rows["w", w, lang] += n
            for order in ORDERS:
                for g in grams(w, order):
                    rows["g", g, lang] += n
        keys = list(rows)
        for lo in range(0, len(keys), 50_000):
            part = keys[lo:lo + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in part], pa.string()) for i in range(3)]
                + [pa.array([rows[k] for k in part], pa.int64())], ["kind", "item", "lang", "n"])

    return sample.mapInArrow(count, "kind string, item string, lang string, n long")


def _most(counts: DataFrame, by: list[str], max_words: int, max_grams: int) -> DataFrame:
    """The most frequent words and n-grams of each group."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "item"))
    most = F.when(F.col("kind") == "w", max_words).otherwise(max_grams)
    return counts.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def learn(labelled: DataFrame, max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS,
          max_grams: int = MAX_GRAMS) -> Model:
    """``labelled`` has id, lang, text."""
    # one row per language
    shares = labelled.groupBy("lang").agg(F.ceil(F.lit(max_docs * _SCALE) / F.count("*")).alias("share"))
    drawn = labelled.join(F.broadcast(shares), "lang").filter(
        F.pmod(F.xxhash64("id", "text"), F.lit(_SCALE)) < F.col("share")).select("lang", "text")
    counts = staged(_counted(drawn.filter("text IS NOT NULL")).groupBy("kind", "item", "lang")
                    .agg(F.sum("n").alias("n")), "language-counts")
    # first in parts of each language, so that no task ranks all of its items
    part = F.pmod(F.xxhash64("item"), F.lit(64))
    some = _most(counts.withColumn("part", part), ["kind", "lang", "part"], max_words, max_grams)
    chosen = _most(some, ["kind", "lang"], max_words, max_grams).select("kind", "item").distinct()
    rows = counts.join(chosen, ["kind", "item"], "left_semi").toArrow()  # languages squared times the bounds at most
    drop_staged(counts)
    langs = sorted(set(rows.column("lang").unique().to_pylist()))
    place = {lang: i for i, lang in enumerate(langs)}
    tables = {"w": {}, "g": {}}
    for batch in rows.sort_by([("kind", "ascending"), ("item", "ascending")]).to_batches(max_chunksize=1 << 14):
        for kind, item, lang, n in zip(*(batch.column(c).to_pylist() for c in ("kind", "item", "lang", "n"))):
            tables[kind].setdefault(item, [0] * len(langs))[place[lang]] = n
    return Model(langs, tables["w"], tables["g"])


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             **bounds: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    spark = df.sparkSession
    ship_package(spark)
    held_out = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
                     held_out.alias("held_out"))
    labelled = docs.filter("id IS NOT NULL AND lang IS NOT NULL AND NOT held_out")
    model = spark.sparkContext.broadcast(learn(labelled, **bounds))

    def predict(batches):
        predictor = Predictor(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                found = [predictor.predict(t) for t in batch.column(2).slice(at, ROWS).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, ROWS), batch.column(1).slice(at, ROWS),
                     pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "held_out", "text").mapInArrow(
        predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
