import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shardline.llm import token_alignment as ta


@pytest.fixture(scope="module")
def aligner():
    return ta.Aligner(ta.vocabularies())


def brute(aligner, text):
    """(a ids, b ids, links, groups) by the libraries and two pointers over whole texts."""
    a = aligner.a.encode(" " + (text or ""), add_special_tokens=False).ids
    b = aligner.b.encode(text or "")
    va, vb = aligner.vocab.a_bytes, aligner.vocab.b_bytes
    data = (" " + (text or "")).encode()
    if not text or b"".join(va[i] for i in a) != data or b"".join(vb[i] for i in b) != data:
        return [], [], [], []
    links, groups, i, j, i0, j0, ea, eb = [], [], 0, 0, 0, 0, len(va[a[0]]), len(vb[b[0]])
    while i < len(a):
        links.append((i, j))
        move_a, move_b = ea <= eb, eb <= ea
        if move_a and move_b:
            groups.append((a[i0:i + 1], b[j0:j + 1]))
            i0, j0 = i + 1, j + 1
        if move_a:
            i += 1
            ea += len(va[a[i]]) if i < len(a) else 0
        if move_b:
            j += 1
            eb += len(vb[b[j]]) if j < len(b) else 0
    return a, b, links, groups


def contract(aligner, rows):
    done = [(r.doc_id, *brute(aligner, r.text)) for r in rows]
    counts = Counter((a[i], b[j]) for _, a, b, links, _ in done for i, j in links)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for doc_id, a, b, links, groups in done:
        pairs = [(a[i], b[j]) for i, j in links]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in pairs),
                    sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _check(df, aligner, **options):
    got = ta.alignment_digest(df, **options).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == contract(aligner, df.select("doc_id", "text").collect())


ODD = ["", " ", "a ", "  a", "a  b", "\na\n", "<|endoftext|> <s> <unk> <0x41>", "a▁b", "é ï ½ ﬁ 中文字 　x", "🙂🙂 z",
       "x" * 3000, "\x00a", "a \x1c b", "it's 're", "tab\t tab", " a", "a b ‍"]


def test_equal_to_brute_force(spark, small_docs, edge, aligner):
    _check(small_docs, aligner)
    _check(edge, aligner)
    _check(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").repartition(3), aligner)
    assert ta.alignment_digest(edge.limit(0)).count() == 0


def test_shards_share_counts(spark, small_docs, aligner):
    """Counts are of the corpus, however its documents are dealt to shards and tasks."""
    _check(small_docs.repartition(5), aligner, shard_links=1)


def test_real_outputs(spark, small_docs, aligner):
    rows = {r.doc_id: r for r in ta.align(small_docs).collect()}
    for r in small_docs.collect():
        a, b, links, groups = brute(aligner, r.text)
        got = rows[r.doc_id]
        assert (got.a_ids, got.b_ids, list(zip(got.link_a, got.link_b))) == (a, b, links)
        assert np.diff(got.cut_a, prepend=-1).tolist() == [len(x) for x, _ in groups]
        assert np.diff(got.cut_b, prepend=-1).tolist() == [len(y) for _, y in groups]


@settings(max_examples=100, deadline=None)
@given(texts=st.lists(st.text(max_size=40), min_size=1, max_size=8))
def test_any_text(aligner, texts):
    found = aligner.align(texts)
    groups, at = ta.group_texts(found), found.link_at
    for k, t in enumerate(texts):
        a, b, links, want = brute(aligner, t)
        assert found.a_ids[found.a_at[k]:found.a_at[k + 1]].tolist() == a
        assert bytes(groups[k]).decode() == ";".join("|".join(",".join(map(str, s)) for s in g) for g in want)
        own = slice(at[k], at[k + 1])
        assert list(zip((found.link_a[own] - found.a_at[k]).tolist(), (found.link_b[own] - found.b_at[k]).tolist())) == links


@settings(max_examples=100, deadline=None)
@given(docs=st.lists(st.tuples(st.sets(st.integers(1, 199), max_size=60), st.sets(st.integers(1, 199), max_size=60)), min_size=1, max_size=5),
       lane=st.sampled_from([1, 3, 64]))
def test_lanes(docs, lane):
    """However a document is cut into lanes, the links are those of its byte ranges."""
    a = [sorted(x | {200}) for x, _ in docs]
    b = [sorted(y | {200}) for _, y in docs]
    shift = lambda ends: np.array([e + 200 * k for k, es in enumerate(ends) for e in es])
    at = np.cumsum([0] + [len(x) for x in a])
    got = ta.merge_lockstep(shift(a), shift(b), at, lane)
    ea, eb = shift(a), shift(b)
    sa, sb = np.append(0, ea)[:-1], np.append(0, eb)[:-1]
    assert list(zip(*got[:2])) == [(i, j) for i in range(len(ea)) for j in range(len(eb)) if sa[i] < eb[j] and sb[j] < ea[i]]
    assert ea[got[2]].tolist() == sorted(set(ea) & set(eb)) == eb[got[3]].tolist()


def test_ids_of_many_words_are_taken_at_once():
    """Each word's ids are slices of one array; a word whose bytes differ spoils no other."""
    aligner = ta.Aligner(ta.vocabularies())
    ids, at = aligner._flat([[5], [6, 7, 8], [9]])
    assert ids.tolist() == [5, 6, 7, 8, 9] and at.tolist() == [0, 1, 4, 5]
    words = ["plain", "", "Été", "unlikelyword", "x,y"]
    alone = [aligner._encoded([w])[0] for w in words]
    assert None not in alone and aligner._encoded(words) == alone
    assert aligner._encoded([*words, "\u2581"]) == [*alone, None]


def test_plain_words_go_to_the_merge_model():
    """Letters and the symbols behind them give the ids of the whole tokenizer, which only gets the rest."""
    aligner = ta.Aligner(ta.vocabularies())
    words = ["plain", "Été,", "ÿ", "word...", "a{}!", "don't", "x1", "日本", "", "a\n", "<|endoftext|>", "ÄÖÜ-"]
    want = [aligner.a.encode(" " + w, add_special_tokens=False).ids for w in words]
    asked, whole = [], aligner.a

    class Library:
        model = whole.model

        def encode_batch_fast(self, texts, **kw):
            asked.extend(texts)
            return whole.encode_batch_fast(texts, **kw)

    aligner.a = Library()
    assert aligner.vocab.by_letters and aligner._a_encoded(words) == want
    assert not any(w in asked for w in (" plain", " Été,", " word...", " ÄÖÜ-")) and " don't" in asked


def test_letters_are_merged_once_and_stay_in_the_worker():
    """Words that share their letters are one merge, texts' words are found by Arrow, and what they gave is
    kept for the worker's later tasks; a text whose bytes differ spoils no other."""
    vocab = ta.vocabularies()
    aligner = ta.kept_aligner(vocab)
    merged, whole = [], aligner.a

    class Library:
        class model:
            @staticmethod
            def tokenize(letters):
                merged.append(letters)
                return whole.model.tokenize(letters)

        encode_batch_fast = whole.encode_batch_fast

    texts = ["zyxabc zyxabc, zyxabc. end", None, "", "zyxabc! \ufb01 end", "end", "end ", "zyxabc  end", "a\u2581b", "end\u2003 \u2003x"]
    want = [brute(aligner, t)[:2] for t in texts]
    aligner.a = Library()
    for _ in range(2):
        a_ids, b_ids, a_at, b_at = ta.kept_aligner(vocab).tokens(texts)
        assert [(a_ids[i:j].tolist(), b_ids[k:m].tolist())
                for i, j, k, m in zip(a_at, a_at[1:], b_at, b_at[1:])] == want
    aligner.a = whole
    assert [m[1:] for m in merged].count("zyxabc") == 1 and ([], []) in want[3:]
