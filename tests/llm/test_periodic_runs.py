import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shardline.llm import periodic_runs as runs


def brute(words, least=12):
    """Each period by itself: maximal stretches of equal words that far apart."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i > s and i + p - s >= max(least, 2 * p):
                found.setdefault((s, i + p), p)
            i += i == s
    return sorted((s, e - s, p) for (s, e), p in found.items())


def contract(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def _check(df):
    got = sorted((tuple(r) for r in runs.runs_digest(df).collect()), key=str)
    assert got == sorted((contract(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def test_equal_to_brute_force(spark, small_docs, edge):
    _check(small_docs.filter("length(text) < 12000 OR text IS NULL"))
    _check(edge.filter("doc_id IS NULL OR doc_id <> 6"))
    assert runs.runs_digest(edge.limit(0)).count() == 0


def test_planted(spark):
    """Every tenth id by its hash gets a periodic end, whatever the text."""
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0][:120]
    rows = [(i, "\n".join(f"w{k * i % 97}" for k in range(i % 140)) if i % 7 else None) for i in ids]
    _check(spark.createDataFrame(rows + [(-1, "a b " * 40)], "doc_id long, text string").repartition(3))


def test_long_run_of_one_word(spark):
    row = runs.periodic_runs(spark.createDataFrame([(1, "word " * 30_000)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(0, 30_000, 1)] and row.collapsed == "word" and row.n_words == 30_000


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.tuples(st.lists(st.integers(1, 4), max_size=70), st.integers(1, 9), st.integers(0, 60)), max_size=6),
       least=st.sampled_from([2, 5, 12]))
def test_any_words(texts, least):
    texts = [(t + (t[-p:] * n))[:160] if t else t for t, p, n in texts]
    found = runs.runs_of([np.array(t, np.int32) for t in texts], least)
    for k, t in enumerate(texts):
        assert [tuple(r[1:]) for r in found.tolist() if r[0] == k] == brute(t, least)


@settings(max_examples=150, deadline=None)
@given(words=st.lists(st.integers(1, 3), min_size=2, max_size=90), data=st.data())
def test_agreement(words, data):
    """Grammar queries of both directions against word by word."""
    seq = np.array([0, *words, 0], np.int32)
    levels = runs.recompress(seq)
    x = data.draw(st.integers(1, len(words) - 1))
    y = data.draw(st.integers(x + 1, len(words)))
    ahead = next(k for k in range(len(seq)) if seq[y + k] == 0 or seq[x + k] != seq[y + k])
    behind = next(k for k in range(len(seq)) if seq[x - k] == 0 or seq[x - k] != seq[y - k])
    last, back = len(seq) - 1, [level.mirrored() for level in levels]
    assert runs.agreement(levels, np.array([x]), np.array([y])).tolist() == [ahead]
    assert runs.agreement(back, np.array([last - y]), np.array([last - x])).tolist() == [behind]
