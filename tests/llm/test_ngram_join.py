import os
import random
import sys
import time
from unittest import mock

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shardline.llm import components, ngram_join
from shardline.llm.components import connected


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    owners = {}
    for i, s in enumerate(sets):
        for g in s:
            owners.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        if rows[i][0] is None or not s:
            continue
        for j in {j for g in s for j in owners[g] if j < i and rows[j][0] is not None}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), None if d is None else least[find(i)])
                   for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def _got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similarity_classes(df).collect()), key=str)


def test_matches_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    assert len({c for _, _, c in want}) < len(rows)
    assert _got(docs) == want


def test_near_copies_passages_and_edges(spark, edge, monkeypatch):
    """Chains of near copies, one passage in many documents, texts of fewer than
    five words; small blocks, so that every path runs."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    base = [word() for _ in range(150)]
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    for i in range(60):  # near copies with edits of their own, some below the bound
        own = list(base)
        for _ in range(i % 6):
            own[rng.randrange(len(own))] = word()
        rows.append((100 + i, " ".join(own)))
    drift = list(base)
    for i in range(40):  # a chain: each is near the last, not the first
        drift[rng.randrange(len(drift))] = word()
        rows.append((200 + i, " ".join(drift)))
    passage = [word() for _ in range(60)]
    for i in range(50):  # a shared passage, not enough to link by itself
        rows.append((300 + i, " ".join(passage + [word() for _ in range(8 + i)])))
    rows += [(400, "A b C"), (401, "a B c"), (402, "a b"), (403, "a b c d e"), (404, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert _got(df) == brute(rows)


def test_repeated_ids_are_documents_of_their_own(spark):
    """Classes that share their least doc_id don't merge, and one row of a group stays."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    base, alone, other, copied = ([word() for _ in range(60)] for _ in range(4))
    texts = [(2, base), (4, alone), (4, base[:-1] + [word()]), (7, other), (7, other), (8, other[:-1] + [word()]),
             (9, copied), (9, copied), (4, [word() for _ in range(60)]), (5, alone[:-1] + [word()])]
    rows = [(i, " ".join(ws)) for i, ws in texts] + [(None, "x y"), (None, "x y"), (6, ""), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert _got(df) == brute(rows)
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.drop_near_copies(df).collect()), key=str)
    assert kept == sorted([rows[k] for k in (0, 1, 3, 6, 8, 10, 11, 12, 13)], key=str)


def test_empty(docs):
    assert ngram_join.similarity_classes(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=20), min_size=1, max_size=12), st.integers(0, 11))
def test_t_occurrence_search_is_exact(sets, q):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    query = arrays[q % len(arrays)]
    found = set(ngram_join.BlockIndex(arrays).search(query).tolist())
    want = {i for i, s in enumerate(sets)
            if 100 * len(s & set(query.tolist())) >= 80 * len(s | {int(x) for x in query})}
    assert found == want


@pytest.mark.parametrize("probe, step", [(0, 1), (0, 1 << 20), (1 << 40, 1), (1 << 40, 1 << 20)])
def test_probed_and_merged_long_lists_agree(probe, step):
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 62, 60, dtype=np.uint64))
    arrays = [np.unique(np.append(rng.permutation(base)[k // 4:], rng.integers(0, 1 << 62, k // 5, dtype=np.uint64)))
              for k in range(80)]
    with mock.patch.multiple(ngram_join, PROBE=probe, STEP=step):
        index = ngram_join.BlockIndex(arrays)
        for query in arrays[::7]:
            want = [i for i, s in enumerate(arrays)
                    if 100 * len(np.intersect1d(s, query)) >= 80 * len(np.union1d(s, query))]
            assert index.search(query).tolist() == want


def test_search_takes_no_python_step_per_entry():
    """A search runs as many Python calls in a block of 256 sets as in one of 16."""
    def calls(n):
        index = ngram_join.BlockIndex([np.arange(k % 8, 200, dtype=np.uint64) for k in range(n)])
        events = []
        sys.setprofile(lambda frame, event, arg: events.append(event))
        try:
            found = index.search(np.arange(200, dtype=np.uint64))
        finally:
            sys.setprofile(None)
        assert len(found) == n
        return len(events)
    assert calls(256) == calls(16)


@pytest.mark.parametrize("words", [2, 5, 7])
def test_shingles_of_many_texts_at_once(words):
    """A run of texts is hashed in one call, with the sets that each text has alone."""
    rng = random.Random(words)
    texts = [None, b"", b" \n", b"a", b"A a", b"a b c d e", b"a b\x0bc D\xc3\x84 e f", b"x " * 40, "\u00a0 \u2003 z".encode()]
    texts += [" ".join(rng.choice("abAB") for _ in range(rng.randrange(12))).encode() for _ in range(120)]
    with mock.patch.object(pd.util, "hash_array", wraps=pd.util.hash_array) as hashed:
        found, bounds = ngram_join.shingle_sets(texts, words)
    assert hashed.call_count == 1 and len(bounds) == len(texts) + 1
    one, two = ngram_join.signatures(found, bounds)
    names = {}
    for i, t in enumerate(texts):
        ws = (t or b"").lower().split()
        want = {tuple(ws[k:k + words]) for k in range(max(1, len(ws) - words + 1))} if ws else set()
        got = found[bounds[i]:bounds[i + 1]]
        assert len(got) == len(want) and (got[1:] > got[:-1]).all()
        alone, _ = ngram_join.shingle_sets([t], words)
        assert got.tolist() == alone.tolist()
        assert names.setdefault(frozenset(want), (one[i], two[i])) == (one[i], two[i])
        assert want or not one[i] and not two[i]
    assert len(set(names.values())) == len(names)
    assert [x.tolist() for x in ngram_join.shingle_sets([], words)] == [[], [0]]


def test_first_peel_counts_only(spark):
    """Which sets have enough shared shingles is found without gathering the shingles."""
    sets = [list(range(0, 20)), list(range(2, 22)), list(range(10, 40)), list(range(100, 120)), [7]]
    df = spark.createDataFrame([(i, len(s), s) for i, s in enumerate(sets)], "rep long, n long, grams array<long>")
    enough = ngram_join._enough(df, 80)
    assert "collect_list" not in enough._jdf.queryExecution().toString()
    assert sorted(r.rep for r in enough.collect()) == sorted(r.rep for r in ngram_join._peeled(df, 80).collect()) == [0, 1, 4]


@pytest.mark.parametrize("n", [1, 40])
def test_components(spark, n):
    rng = random.Random(n)
    edges = [(rng.randrange(6 * n), rng.randrange(6 * n)) for _ in range(5 * n)] + [(i, i + 1) for i in range(1000, 1000 + n)]
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    least = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted(least.items())


def test_components_end_with_stars(spark, monkeypatch):
    """Edges that are stars already are read once; a path takes no round beyond its last change."""
    steps = []
    monkeypatch.setattr(components, "staged", lambda df, name, real=components.staged: steps.append(name) or real(df, name))
    stars = [(9, 1), (8, 1), (1, 7), (5, 2), (2, 2), (None, 3)]
    got = connected(spark.createDataFrame(stars, "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in got) == [(1, 1), (2, 2), (5, 2), (7, 1), (8, 1), (9, 1)]
    assert len(steps) == 1
    got = connected(spark.createDataFrame([(3, 2), (2, 1)], "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in got) == [(1, 1), (2, 1), (3, 1)]
    assert len(steps) == 1 + 1 + 4


def test_shuffle_files_go_with_their_step(spark, small_docs):
    """None of the join's shuffles lies on the disk behind it, and the session's settings are as before."""
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    lying = lambda: {n for d in folders for _, _, names in os.walk(d) for n in names if n.startswith("shuffle_")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = lying(), spark.conf.get(key)
    ngram_join.similarity_groups(small_docs)
    assert spark.conf.get(key) == setting
    for _ in range(50):  # files are removed in the background
        if not lying() - before:
            break
        time.sleep(0.1)
    assert not lying() - before
