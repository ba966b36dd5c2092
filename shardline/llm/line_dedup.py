"""Line deduplication: lines found in many documents stay in one of them only.

Lines are exploded, normalised to a key and hashed; distinct documents are
counted per hash; lines over the threshold go everywhere but in the largest
doc_id that holds them; the rest is put together again by position.

Defined results: a null or empty text is one empty line; a null doc_id counts as
no document and never is the keeper; rows that repeat a doc_id count as one
document, and each row is rewritten by its own text; an empty table gives an
empty result. Input columns may have any names: only ``id_col`` and ``text_col``
are looked at, the others are carried in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardline.llm.common import BLANKS, ascii_lower, staged, text_key

MIN_CHARS, MIN_DOCS = 20, 3


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, th, pos, h1, h2) of each line whose key is long enough. Two seeds make
    a 128-bit hash."""
    lines = docs.select("id", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("id", "th", "pos", line_key(F.col("line")).alias("key"))
    return keys.filter(F.char_length("key") >= min_chars).select(
        "id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, th, drop) with the positions of the lines to drop; ``docs`` has id,
    th, text. A key is counted in two steps, by (key, document) and then by key,
    so that a line in a third of all documents is summed up before it meets."""
    lines = _line_hashes(docs, min_chars)
    common = staged(
        lines.select("h1", "h2", "id").distinct()
        .groupBy("h1", "h2").agg(F.count("id").alias("n"), F.max("id").alias("keeper"))
        .filter(F.col("n") >= min_docs).select("h1", "h2", "keeper"), "line-dedup-common")
    # both sides are plain scans, so the join's large partitions can be split at run time
    return (lines.join(common, ["h1", "h2"])
            .filter(~F.col("id").eqNullSafe(F.col("keeper")))
            .groupBy("id", "th").agg(F.collect_set("pos").alias("drop")))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per input row: ``row`` (the input row), ``id``, ``lines`` count,
    ``n_dropped`` and ``kept`` (the text that stays)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("th"))
    drops = dropped_lines(df.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("th"),
                                    text.alias("text")), min_chars, min_docs)
    drops = drops.select(F.col("id").alias("did"), F.col("th").alias("dth"), "drop")
    joined = whole.join(drops, F.col("id").eqNullSafe(F.col("did")) & (F.col("th") == F.col("dth")), "left")
    body = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    lines = F.split(body, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    return (joined.select("row", "id", "drop", body.alias("body"), lines.alias("lines"))
            .select("row", "id", F.size("lines").cast("long").alias("n_lines"),
                    F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
                    F.when(F.col("drop").isNull(), F.col("body")).otherwise(
                        F.array_join(F.transform(stay, lambda p: F.element_at("lines", p + 1)), "\n"))
                    .alias("kept")))


def line_dedup_digest(df: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_lines, n_dropped, kept_sha256."""
    return dedup_lines(df).select(F.col("id").alias("doc_id"), "n_lines",
                                  F.when(F.col("n_dropped") > 0, F.col("n_dropped")).otherwise(F.lit(0))
                                  .cast("long").alias("n_dropped"),
                                  F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


#: One template for the oracle and for the pipeline's SQL: {docs} holds doc_id and text.
LINES_SQL = r"""
  dd_lines AS (
    SELECT doc_id, i AS pos, ls[i] AS line,
           translate(trim(ls[i], E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs}) t,
         unnest(generate_series(1, len(ls))) AS u(i)
  ),
  dd_common AS (
    SELECT k, max(doc_id) AS keeper FROM dd_lines WHERE length(k) >= 20
    GROUP BY k HAVING count(DISTINCT doc_id) >= 3
  ),
  dd_kept AS (
    SELECT l.doc_id, count(*) AS n_lines,
           count(*) FILTER (WHERE c.k IS NOT NULL AND c.keeper <> l.doc_id) AS n_dropped,
           coalesce(string_agg(l.line, chr(10) ORDER BY l.pos)
                    FILTER (WHERE c.k IS NULL OR c.keeper = l.doc_id), '') AS kept
    FROM dd_lines l LEFT JOIN dd_common c USING (k) GROUP BY l.doc_id
  )
"""

ORACLE = ("WITH " + LINES_SQL.format(docs="documents")
          + "SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM dd_kept")
