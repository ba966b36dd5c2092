import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shardline.llm import packing, tokens


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_bpe():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def _check_counts(df, tok):
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(df).collect()), key=str)
    want = []
    for r in df.select("doc_id", "text").collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 512))
    assert got == sorted(want, key=str)


def test_counts_equal_the_library(small_docs, edge, byte_bpe):
    _check_counts(small_docs, byte_bpe)
    _check_counts(edge, byte_bpe)
    assert tokens.count_tokens(edge.limit(0)).count() == 0


def test_whole_tokens_are_single(byte_bpe):
    whole = tokens.whole_tokens(tokens.tokenizer_json("byte_bpe_50k.json"))
    assert len(whole) > 40_000 and " the" in whole
    assert all(len(e.ids) == 1 for e in byte_bpe.encode_batch(sorted(whole)[::50], add_special_tokens=False))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab Zé9'.\n\t  \x1c\x85 ßİ中😀<|>"), max_size=30))
def test_any_text(byte_bpe, word_bpe, text):
    spec = tokens.tokenizer_json("byte_bpe_50k.json")
    if not hasattr(test_any_text, "c"):
        test_any_text.c = (tokens.Counter(spec, tokens.whole_tokens(spec)),
                           tokens.WordIds(tokens.tokenizer_json("word_bpe_49k.json")))
    counter, words = test_any_text.c
    assert counter.count([text]) == [len(byte_bpe.encode(text, add_special_tokens=False).ids)]
    assert np.frombuffer(words.ids([text])[0], "<u4").tolist() == word_bpe.encode(text, add_special_tokens=False).ids


def _check_packing(df, tok, capacity=2048):
    rows = packing.pack(df).collect()
    ids = {}
    for r in df.select("doc_id", "text").collect():
        ids.setdefault(r.doc_id, []).append(tok.encode(r.text or "", add_special_tokens=False).ids + [1])
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for doc, pieces in by_doc.items():
        want = sorted((s, tuple(x[s:s + r.length])) for x in ids[doc] for r in pieces for s in [r.start]
                      if r.doc_tokens == len(x) and zlib.crc32(np.array(x[s:s + r.length], "<u4").tobytes()) == r.ids_crc32)
        assert len(want) >= len(pieces)
        assert sum(r.length for r in pieces) == sum(map(len, ids[doc]))
        if len(ids[doc]) == 1:  # each id in exactly one piece
            at = 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == at
                at += r.length
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
    return by_seq


def test_packing(docs, edge, word_bpe):
    seqs = _check_packing(docs, word_bpe)
    used = sum(r.length for s in seqs.values() for r in s)
    assert used / (2048 * len(seqs)) > 0.98
    _check_packing(edge, word_bpe)
    assert packing.pack(edge.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 512), max_size=60), st.integers(1, 12))
def test_differencing_keeps_every_item(sizes, k):
    groups = packing.difference(sizes, k)
    assert sorted(i for g in groups for i in g) == list(range(len(sizes))) and len(groups) <= k
    done = packing.windows_of(sizes, 700)
    assert sorted(i for g in done for i in g) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in g) <= 700 for g in done)


def test_differencing_is_near_equal():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 513, 800).tolist()
    sums = [sum(sizes[i] for i in g) for g in packing.difference(sizes, 100)]
    assert max(sums) - min(sums) <= 10


def test_letters_are_merged_once_per_call(word_bpe):
    """Words that differ in case or symbols share a merge, also when the worker's table is full."""
    words = tokens.WordIds(tokens.tokenizer_json("word_bpe_49k.json"))

    class Model:
        asked = []

        def tokenize(self, word):
            self.asked.append(word)
            return word_bpe.model.tokenize(word)

    words.model, words.letters = Model(), tokens.Memo(0)
    texts = ["Zebrafinkle zebrafinkle, ZEBRAFINKLE! zebrafinkle;", "zebraFINKLE"]
    got = [np.frombuffer(x, "<u4").tolist() for x in words.ids(texts)]
    assert got == [word_bpe.encode(t, add_special_tokens=False).ids for t in texts]
    assert Model.asked == ["zebrafinkle"]


def test_text_runs_hold_every_row():
    import pyarrow as pa

    texts = ["ab", None, "", "cdefg", "h", "", None]
    runs = list(tokens.text_runs(pa.array(texts), 3))
    assert [t for _, part in runs for t in part] == texts
    assert [lo for lo, _ in runs] == [0, 4] and list(tokens.text_runs(pa.array([], pa.string()))) == []


def test_any_white_space_splits_as_in_python():
    texts = [f" a{chr(c)}B, {chr(c)}" for c in range(0x3100) if chr(c).isspace() or c < 0x100]
    words = tokens.WordIds(tokens.tokenizer_json("word_bpe_49k.json"))
    got = [np.frombuffer(x, "<u4").tolist() for x in words.of(pa.array(texts))]
    assert got == [words.tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_of_a_run_are_looked_up_once():
    """Python sees each distinct word's letters once per run, however many texts hold them."""
    words = tokens.WordIds(tokens.tokenizer_json("word_bpe_49k.json"))

    class Letters(tokens.Memo):
        asked = []

        def get(self, key, *rest):
            self.asked.append(key)
            return super().get(key, *rest)

    words.letters = Letters(0)
    texts = pa.array(["Zebra zebra, ZEBRA! quux; " * 2000] * 30 + [None, "", " \n"])
    bounds = list(tokens.run_bounds(texts))
    assert bounds == [(0, 33)] and list(tokens.run_bounds(pa.array([], pa.string()))) == []
    assert list(tokens.run_bounds(pa.array(["ab", None, "", "cdefg", "h", "", None]), 3)) == [(0, 3), (3, 4)]
    got = words.of(texts.fill_null(""))
    assert sorted(Letters.asked) == ["quux", "zebra"] and got[30:] == [b""] * 3
    assert np.frombuffer(got[0], "<u4").tolist() == words.tok.encode(texts[0].as_py(), add_special_tokens=False).ids
