"""A corpus pipeline over the ``documents`` table, from raw texts to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept;
its result is written as parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardline.llm import decontaminate, line_dedup, ngram_join, packing, quality
from shardline.llm.common import staged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good with probability ``quality.LEAST`` or more stay."""
    return quality.select_good(docs, _table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three documents or more stay in the last one only."""
    kept = line_dedup.dedup_lines(docs)
    rows = kept.select(F.col("row"), F.when(F.col("row.text").isNotNull(), F.col("kept")).alias("kept"))
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return rows.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of smallest doc_id."""
    return ngram_join.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, one row per piece."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: The fitted classifier and the tokenizer can't be written in SQL; line dedup and the
#: n-gram join are tested against brute force instead, the other stages more loosely.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
