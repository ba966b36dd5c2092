import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from shardline.llm import byte_bpe


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.default_codec()


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={r: i for i, r in enumerate(codec.ranks)},
                             special_tokens={})


def _check(df, codec, library):
    got = sorted((tuple(r) for r in byte_bpe.round_trip_digest(df, codec).collect()), key=str)
    want = []
    for r in df.select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_equal_to_the_library(spark, small_docs, edge, codec, library):
    _check(small_docs, codec, library)
    _check(edge, codec, library)
    assert byte_bpe.round_trip_digest(edge.limit(0), codec).count() == 0


def test_every_character(spark, codec, library):
    """All of Unicode, and the characters that libraries class differently, in all surroundings."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    rng = random.Random(5)
    mixed = "".join(rng.choice([*map(chr, codec.odd), *" a1'#s\n\t"]) for _ in range(20_000))
    _check(spark.createDataFrame([(1, every), (2, mixed), (3, "x" * 60_000)], "doc_id long, text string"), codec, library)


def test_model_is_the_vocabulary(codec):
    """Each vocabulary string alone gives its own rank, or is listed as one that merging misses."""
    model = codec.open().model
    assert model.get_piece_size() == len(codec.ranks) + 1
    missed = [i for i, r in enumerate(codec.ranks) if model.encode(byte_bpe.as_chars(r)) != [i]]
    assert {codec.whole.get(codec.ranks[i].decode()) for i in missed} <= set(missed)
    assert all(byte_bpe.as_bytes(byte_bpe.as_chars(r)) == r for r in codec.ranks)


def test_encode_then_decode(spark, edge, codec):
    ids = byte_bpe.encode(edge, codec)
    back = byte_bpe.decode(ids, codec).withColumnRenamed("doc_id", "i")
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((r.text or "").encode() for r in edge.collect())
    odd = spark.createDataFrame([(1, None), (2, []), (3, [5, None]), (4, [len(codec.ranks)]), (5, [-1])], "doc_id long, ids array<int>")
    assert [None if r.decoded is None else bytes(r.decoded) for r in byte_bpe.decode(odd, codec).orderBy("doc_id").collect()] == [
        b"", b"", None, None, None]


def test_other_ranks(spark, small_docs):
    """A vocabulary that merging alone doesn't reach in full: a whole pre-token with a rank is one token."""
    ranks = [bytes([b]) for b in range(256)] + [b"ab", b"wxyz", b" abc"]
    made = byte_bpe.Codec(ranks, byte_bpe.sentencepiece_model(ranks), P.PATTERN, {"wxyz": 257, " abc": 258})
    lib = tiktoken.Encoding("tiny", pat_str=P.PATTERN, mergeable_ranks={r: i for i, r in enumerate(ranks)}, special_tokens={})
    _check(small_docs.limit(20), made, lib)
    _check(spark.createDataFrame([(1, "wxyz abc abcd wxyzw ab")], "doc_id long, text string"), made, lib)


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=200))
def test_any_text(codec, library, text):
    bpe = test_any_text.__dict__.setdefault("bpe", None) or codec.open()
    test_any_text.bpe = bpe
    ids = [int.from_bytes(bpe.encode([text])[0][i:i + 4], "little") for i in range(0, 4 * len(library.encode_ordinary(text)), 4)]
    assert ids == library.encode_ordinary(text) and bpe.decode(ids) == text.encode()
