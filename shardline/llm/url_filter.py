"""URL filter: explicit host/path rules, and a logistic regression on hashed
character n-grams of host and path for all other URLs.

The model learns from a small labelled URL table of (host, path, blocked), by default
the one in ``url_labels``, whose labels don't come from the rules. It is read as a
bounded sample: at most ``max_rows`` distinct labelled URLs, half of them of each class as
far as it has so many, the ones of smallest hash. Scoring sees every URL, whole.

Defined results: a null URL, or one without ``://``, has empty host and path; no
rule fits it and the model sees no n-gram, so the verdict is that of the
intercept. Without any labelled URL the model allows. Of rules of equal length
block wins. Only the URL column is read; columns of other names are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardline.llm import url_labels
from shardline.llm.common import ascii_lower
from shardline.session import ship_package

#: The rules of the contract, (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BITS, GRAMS, MAX_ROWS, STEPS = 16, (3, 4, 5), 4096, 200


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2 ** 31 - 1))).otherwise("")
    part = lambda g: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", g), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits, else nulls. The rules
    become one expression, so they should be hundreds, not millions."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def ngrams(host: str, path: str, bits: int = BITS) -> np.ndarray:
    """Hashed n-grams, distinct. Host and path have ids of their own; digits are
    all one digit, so that page numbers teach nothing."""
    grams = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        if len(text) > 2:
            text = "".join("0" if c.isdigit() else c for c in text)
            grams.update(mark + text[i:i + n] for n in GRAMS for i in range(max(1, len(text) - n + 1)))
    if not grams:
        return np.empty(0, np.int64)
    hashed = pd.util.hash_array(np.array(sorted(grams), dtype=object), categorize=False)
    return np.unique(hashed & np.uint64((1 << bits) - 1)).astype(np.int64)


def fit(rows: list[tuple[str, str, int]], bits: int = BITS, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by full-batch AdaGrad, classes weighed
    equally. Deterministic: rows are sorted first."""
    weight, bias = np.zeros(1 << bits), 0.0
    y = np.array([r[2] for r in sorted(rows)], float)
    if not rows or y.min() == y.max():
        return weight, -1.0 if not rows or y.max() == 0 else 1.0
    feats = [ngrams(h, p, bits) for h, p, _ in sorted(rows)]
    sizes = np.array([len(f) for f in feats])
    cols, owner = np.concatenate(feats), np.repeat(np.arange(len(rows)), sizes)
    scale = 1 / np.sqrt(np.maximum(sizes, 1))
    value = scale[owner]
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    seen, seen_b = np.full(weight.shape, 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(owner, weight[cols] * value, len(rows)) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        g = np.bincount(cols, err[owner] * value, len(weight)) + 1e-5 * weight
        seen, seen_b = seen + g * g, seen_b + err.sum() ** 2
        weight -= 0.5 * g / np.sqrt(seen)
        bias -= 0.5 * err.sum() / np.sqrt(seen_b)
    return weight, float(bias)


def blocked_probability(host: str, path: str, weight: np.ndarray, bias: float, bits: int = BITS) -> float:
    f = ngrams(host, path, bits)
    z = weight[f].sum() / np.sqrt(max(len(f), 1)) + bias
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(labelled: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS) -> tuple[np.ndarray, float]:
    """``labelled`` has host, path, blocked (0/1). At most ``max_rows`` distinct
    rows of each class come to the driver, and as many in all are learned from."""
    rows = labelled.select("host", "path", F.col("blocked").cast("int").alias("blocked")).distinct()
    good, bad = (rows.filter(F.col("blocked") == c).orderBy(F.xxhash64("host", "path"), "host", "path")
                 .limit(max_rows).collect() for c in (0, 1))
    most = max(max_rows // 2, max_rows - len(bad))
    good = good[:most]
    return fit([(r.host, r.path, r.blocked) for r in good + bad[:max_rows - len(good)]], bits)


def filter_urls(df: DataFrame, url_col: str = "url", labelled: DataFrame | None = None, rules=RULES,
                max_rows: int = MAX_ROWS, bits: int = BITS) -> DataFrame:
    """``row`` (the input row), host, path, rule, verdict, p_block of every row.

    ``labelled``: the labelled URL table; by default that of ``url_labels``."""
    host, path = host_path(F.col(url_col))
    split = df.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    if labelled is None:
        labelled = df.sparkSession.createDataFrame(url_labels.rows(), "host string, path string, blocked int")
    weight, bias = train(labelled, max_rows, bits)
    ship_package(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast((weight, bias))  # 2**bits doubles

    @F.pandas_udf("double")
    def p_block(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        w, b = model.value
        return pd.Series([blocked_probability(h, p, w, b, bits) for h, p in zip(hosts, paths)], dtype=float)

    scored = split.select("row", "host", "path", rule.alias("rule"), verdict.alias("given"),
                          p_block("host", "path").alias("p_block"))
    return scored.select("row", "host", "path", "rule",
                         F.coalesce("given", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
                         .alias("verdict"), "p_block")
